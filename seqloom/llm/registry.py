"""Queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from seqloom.llm import archives, chat, html, langid, lattice, licenses, minhash, mixing, packing, phrases, pieces, quality, repair
from seqloom.llm.common import table

QUERIES = {
    "op1_sentencepiece": lambda spark, d: pieces.token_report(table(spark, d, "documents")),
    "op2_quality_rules": lambda spark, d: quality.quality_report(table(spark, d, "documents")),
    "op3_language_id": lambda spark, d: langid.language_report(table(spark, d, "documents")),
    "op4_warc": lambda spark, d: archives.archive_report(table(spark, d, "pages")),
    "op5_chat_format": lambda spark, d: chat.chat_report(table(spark, d, "conversations")),
    "op6_html_text": lambda spark, d: html.text_report(table(spark, d, "pages")),
    "op7_license_scan": lambda spark, d: licenses.license_report(table(spark, d, "documents")),
    "op8_lattice_dedup": lambda spark, d: lattice.near_duplicates(table(spark, d, "embeddings")),
    "op9_minhash_dedup": lambda spark, d: minhash.near_duplicates(table(spark, d, "documents")),
    "op10_mixing": lambda spark, d: mixing.mixed(table(spark, d, "documents")),
    "op11_packing": lambda spark, d: packing.packed(table(spark, d, "documents")),
    "op12_phrases": lambda spark, d: phrases.collocations(table(spark, d, "documents")),
    "op13_repair": lambda spark, d: repair.repair_report(table(spark, d, "conversations")),
}
ORACLES = {
    "op2_quality_rules": quality.QUALITY_SQL,
    "op4_warc": archives.ARCHIVE_SQL,
    "op5_chat_format": chat.CHAT_SQL,
    "op7_license_scan": licenses.LICENSE_SQL,
    "op10_mixing": mixing.MIXING_SQL,
    "op12_phrases": phrases.PHRASES_SQL,
    "op13_repair": repair.REPAIR_SQL,
}
