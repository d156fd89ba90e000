"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

A text becomes units, cut wherever no piece holds the two characters side by side (so before each run of spaces, which
are U+2581 here). The distinct units of a batch that are new to the worker are encoded, equal lengths together: for
every end and every piece length, the hash of that substring probes the sorted hashes of all pieces (a table of their
leading bits spares most of the searches), and the maximum over the candidates is kept with its backpointer.

For a unigram model a candidate is worth the sum of its pieces' scores. A BPE model has no additive scores, but its
segmentation is the only one whose neighbours are all compatible (no merge that crosses their border would have come
before the merges that made them); a compatible candidate is worth its length, any other nothing. Whether two pieces
are compatible is decided by walking down the border of their merge trees, for all pairs of a step at once. Runs of
spaces, whose pieces tie in score, are merged by a queue, once per length.

Characters outside the model become byte pieces (or the unknown piece if the model has none). Null and empty texts
have no tokens and decode to the empty text; undecodable bytes count as U+FFFD; U+2581 decodes to a space, as the
format has it. Only models without text normalisation are read. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import struct
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches
from seqloom.llm.shingles import buffers, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
_ROOT = np.uint64(0x9E3779B97F4A7C15)  # base of the rolling hash
_NEVER = np.int64(1) << 60
_CACHE_BITS = 20
_UNITS = 400_000  # distinct units a worker remembers

# Fixed values of the model file's format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class Pieces:
    """A model file, read: pieces, scores and types by id."""

    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            data = f.read()
        self.texts, self.scores, self.types, self.kind, self.prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(piece.get(2, 0.0))
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
                self.prefix = bool(norm.get(3, 1))
                if norm.get(2) or norm.get(4, 1):
                    raise ValueError("only models without text normalisation are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is not supported")
        self.key = hash((path, len(data), data[:4096], data[-4096:]))


def _hash_codes(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x51ED270B7))


def _powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 1), _ROOT, np.uint64))))


def _hash_text(text: str) -> int:
    codes = _hash_codes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    return int((codes * _powers(len(codes))[: len(codes)][::-1]).sum(dtype=np.uint64))


class Encoder:
    """What a worker needs to encode and decode: built once from Pieces, with its caches."""

    def __init__(self, p: Pieces):
        self.bpe, self.prefix = p.kind == BPE, p.prefix
        usable = [i for i, t in enumerate(p.types) if t in (NORMAL, USER_DEFINED)]
        self.runs = {len(p.texts[i]): i for i in usable if set(p.texts[i]) == {chr(SPACE)}}
        # Longer runs of spaces tie in score: a BPE model merges them apart from the rest.
        plain = [i for i in usable if not (self.bpe and len(p.texts[i]) > 1 and set(p.texts[i]) == {chr(SPACE)})]
        size = len(p.texts)
        self.length = np.array([len(t) for t in p.texts] + [1], np.int64)
        self.score = np.array([*p.scores, 0.0], np.float64)
        self.unknown_score = min((p.scores[i] for i in plain), default=0.0) - 10
        self.none = size  # stands for a character outside the model
        self.hash = np.zeros(size + 1, np.uint64)
        self.hash[plain] = [_hash_text(p.texts[i]) for i in plain]
        self.made = np.full(size + 1, -1, np.int64)  # when a piece is merged; characters are there from the start
        self.left, self.right = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
        if self.bpe:
            plain = self._trees(p, plain)
        order = np.argsort(self.hash[plain])
        self.sorted_ids = np.array(plain, np.int64)[order]
        self.sorted_hash = self.hash[self.sorted_ids]
        if (self.sorted_hash[1:] == self.sorted_hash[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.longest = max((len(p.texts[i]) for i in plain), default=1)
        self.power = _powers(self.longest + 1)
        self.leading = np.zeros(1 << _CACHE_BITS, bool)
        self.leading[self.sorted_hash >> np.uint64(64 - _CACHE_BITS)] = True
        pairs = {ord(a) << 21 | ord(b) for i in usable for a, b in zip(p.texts[i], p.texts[i][1:], strict=False)}
        self.side_by_side = np.sort(np.array(list(pairs), np.uint64))
        self.pair_leading = np.zeros(1 << _CACHE_BITS, bool)
        self.pair_leading[mix(self.side_by_side.copy()) >> np.uint64(64 - _CACHE_BITS)] = True
        self.ascii_pairs = np.zeros((128, 128), bool)
        for pair in pairs:
            if pair >> 21 < 128 and pair & 0x1FFFFF < 128:
                self.ascii_pairs[pair >> 21, pair & 0x1FFFFF] = True
        bytes_ = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(p.texts, p.types, strict=True)) if k == BYTE}
        self.byte_ids = np.array([bytes_[b] for b in range(256)], np.int64) if len(bytes_) == 256 else None
        self.unknown = next((i for i, k in enumerate(p.types) if k == UNKNOWN), 0)
        raw = [t.replace(chr(SPACE), " ").encode() if k in (NORMAL, USER_DEFINED) else bytes([int(t[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for t, k in zip(p.texts, p.types, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.pairs = np.full(1 << _CACHE_BITS, -1, np.int64)
        self.pair_ok = np.zeros(1 << _CACHE_BITS, bool)
        self.forget()

    def _trees(self, p: Pieces, plain: list[int]) -> list[int]:
        """The last merge of each piece; pieces that their own merges do not lead to can never occur and are left out."""
        ids = {p.texts[i]: i for i in plain}
        rank = {p.texts[i]: n for n, i in enumerate(sorted(plain, key=lambda i: (-p.scores[i], i)))}
        kept = []
        for i in plain:
            parts = list(p.texts[i])
            last = None
            while len(parts) > 1:
                found = [(rank[a + b], n) for n, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
                if not found:
                    break
                n = min(found)[1]
                last = parts[n], parts[n + 1]
                parts[n : n + 2] = [parts[n] + parts[n + 1]]
            if len(parts) > 1:
                continue
            kept.append(i)
            if last:
                self.made[i] = rank[p.texts[i]]
                self.left[i], self.right[i] = (ids.get(x, self.none) for x in last)
        return kept

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        self.joined = np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece with each hash, -1 if there is none."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.leading[hashes >> np.uint64(64 - _CACHE_BITS)])
        sought = hashes[maybe]
        n = np.minimum(np.searchsorted(self.sorted_hash, sought), len(self.sorted_hash) - 1)
        there = self.sorted_hash[n] == sought
        out[maybe[there]] = self.sorted_ids[n[there]]
        return out

    def uncut(self, codes: np.ndarray) -> np.ndarray:
        """For each character but the first: whether some piece may hold it together with the one before."""
        a, b = codes[:-1], codes[1:]
        if self.byte_ids is None:  # unknown characters in a row are one token: cut before spaces only
            return (b != SPACE) | (a == SPACE)
        out = self.ascii_pairs[np.minimum(a, 127), np.minimum(b, 127)]
        wide = np.flatnonzero((a > 127) | (b > 127))
        keys = (a[wide].astype(np.uint64) << np.uint64(21)) | b[wide]
        found = self.pair_leading[mix(keys) >> np.uint64(64 - _CACHE_BITS)]
        n = np.minimum(np.searchsorted(self.side_by_side, keys[found]), len(self.side_by_side) - 1)
        found[found] = self.side_by_side[n] == keys[found]
        out[wide] = found
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a border between each a and the b after it."""
        key = (a << 32) | b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        new = self.pairs[slot] != key
        out = self.pair_ok[slot]
        if new.any():
            out[new] = self._border(a[new], b[new])
            self.pairs[slot[new]], self.pair_ok[slot[new]] = key[new], out[new]
            # Two new keys of one slot: the stored answer may be the other's, so only consistent slots stay.
            bad = self.pairs[slot[new]] != key[new]
            self.pairs[slot[new][bad]] = -1
        return out

    def _border(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (a == self.none) | (b == self.none)
        todo = np.flatnonzero(~ok)
        x, y = a[todo], b[todo]
        over_x, over_y = np.full(len(todo), _NEVER), np.full(len(todo), _NEVER)
        while len(todo):
            joint = self.find(self.hash[x] * self.power[np.minimum(self.length[y], self.longest + 1)] + self.hash[y])
            joint[self.length[x] + self.length[y] > self.longest] = -1
            when = np.where(joint >= 0, self.made[joint], _NEVER)
            crossed = (when < over_x) & (when <= over_y)
            first = (self.made[x] < 0) & (self.made[y] < 0)
            ok[todo[~crossed & first]] = True
            go = ~crossed & ~first
            todo, x, y, over_x, over_y = todo[go], x[go], y[go], over_x[go], over_y[go]
            down = self.made[x] > self.made[y]
            over_x, over_y = np.where(down, self.made[x], over_x), np.where(down, over_y, self.made[y])
            x, y = np.where(down, self.right[x], x), np.where(down, y, self.left[y])
        return ok

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of words of one length (rows of code points), filled up with -1 at the left; `none` for characters
        outside the model."""
        n, width = codes.shape
        h = _hash_codes(codes)
        prefix = np.zeros((width + 1, n), np.uint64)
        for j in range(width):
            prefix[j + 1] = prefix[j] * _ROOT + h[:, j]
        best = np.full((width + 1, n), -np.inf)
        token = np.full((width + 1, n), self.none, np.int64)
        best[0] = 0
        rows = np.arange(n)
        for end in range(1, width + 1):
            for size in range(1, min(end, self.longest) + 1):
                begin = end - size
                piece = self.find(prefix[end] - prefix[begin] * self.power[size])
                if size == 1:
                    piece = np.where(piece < 0, self.none, piece)
                got = np.flatnonzero(piece >= 0)
                if not len(got):
                    continue
                piece = piece[got]
                if self.bpe:
                    fits = np.ones(len(got), bool) if begin == 0 else self.compatible(token[begin, got], piece)
                    value = np.where(fits, float(size), -np.inf)
                else:
                    value = best[begin, got] + np.where(piece == self.none, self.unknown_score, self.score[piece])
                better = value > best[end, got]
                at = got[better]
                best[end, at], token[end, at] = value[better], piece[better]
        # Follow the backpointers of all words together.
        at, out = np.full(n, width), []
        while (at > 0).any():
            t = np.where(at > 0, token[at, rows], -1)
            out.append(t)
            at = np.where(at > 0, at - self.length[np.maximum(t, 0)], 0)
        return np.array(out[::-1]).T if out else np.empty((n, 0), np.int64)

    @cache  # noqa: B019  one encoder per worker
    def run(self, n: int) -> tuple[int, ...]:
        """Tokens of n spaces by themselves, merged by score, then from the left."""
        size, after, before = [1] * n, [*range(1, n + 1)], [*range(-1, n - 1)]

        def joint(i):
            return size[i] + size[after[i]] if after[i] < n else 0

        queue = [(-self.score[self.runs[2]], i, 2) for i in range(n - 1)] if 2 in self.runs else []
        while queue:
            _, i, total = heappop(queue)
            if not size[i] or joint(i) != total:
                continue
            j = after[i]
            size[i], size[j], after[i] = total, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and joint(k) in self.runs:
                    heappush(queue, (-self.score[self.runs[joint(k)]], k, joint(k)))
        return tuple(self.runs.get(x, self.none) for x in size if x)

    def _finish(self, spaces: int, core: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Put the further spaces before a word's tokens, and spell what the model does not have. text: the word with
        its last space."""
        if (core == self.none).any():
            out, at = [], 0
            for t in core:
                if t != self.none:
                    out.append(t)
                elif self.byte_ids is not None:
                    out.extend(self.byte_ids[list(chr(text[at]).encode("utf-8", "surrogatepass"))])
                elif not (out and out[-1] == self.unknown):
                    out.append(self.unknown)
                at += int(self.length[t])
            core = np.array(out, np.int64)
        if self.bpe and spaces > 1:
            alone = len(core) and core[0] == self.runs.get(1, self.none)
            core = np.concatenate((self.run(spaces), core[1:])) if alone else np.concatenate((self.run(spaces - 1), core))
        return core.astype(np.int32)

    def _keep(self, keys: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        size = len(self.known)
        self.known.update(zip(keys.tolist(), range(size, size + len(keys)), strict=True))
        self.flat.append(tokens.astype(np.int32))
        self.counts.append(counts)

    def learn(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray) -> None:
        """Encode the units codes[begin : begin + size] and remember their tokens by key."""
        spaces = np.zeros(len(begin), np.int64)
        run = np.flatnonzero(codes[begin] == SPACE)
        while len(run):
            spaces[run] += 1
            run = run[spaces[run] < size[run]]
            run = run[codes[begin[run] + spaces[run]] == SPACE]
        more = np.maximum(spaces - 1, 0) if self.bpe else np.zeros(len(begin), np.int64)
        width = size - more
        order = np.argsort(width, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(width[order])) + 1):
            n = int(width[group[0]])
            step = max(1, (1 << 18) // max(n, 1))
            for s in range(0, len(group), step):
                units = group[s : s + step]
                words = codes[(begin[units] + more[units])[:, None] + np.arange(n)]
                grid = self.viterbi(words)
                got = grid >= 0
                odd = (more[units] > 0) | (grid == self.none).any(1)
                plain = ~odd
                if plain.any():
                    self._keep(keys[units[plain]], grid[plain][got[plain]], got[plain].sum(1))
                if odd.any():
                    done = [self._finish(int(spaces[units[k]]), grid[k][got[k]], words[k]) for k in np.flatnonzero(odd)]
                    self._keep(keys[units[odd]], np.concatenate(done), np.array([len(d) for d in done], np.int64))
        self.flat, self.counts = [np.concatenate(self.flat)], [np.concatenate(self.counts)]
        self.joined = np.concatenate(([0], np.cumsum(self.counts[0])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts, and where each text's begin."""
        lead = chr(SPACE) if self.prefix else ""
        spelled = [(lead + t).replace(" ", chr(SPACE)) if t else "" for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in spelled])))
        codes = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        start = np.ones(len(codes), bool)
        start[1:] = ~self.uncut(codes)
        start[bounds[:-1][np.diff(bounds) > 0]] = True
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, len(codes)))
        place = np.arange(len(codes)) - np.repeat(begin, size)
        keys = mix(np.add.reduceat(_hash_codes(codes) * _powers(int(size.max()))[place], begin) ^ size.astype(np.uint64))
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        listed = keys.tolist()
        if len(self.known) + len(listed) > _UNITS:
            self.forget()
        new = np.flatnonzero([k not in self.known for k in listed])
        if len(new):
            self.learn(codes, begin[first[new]], size[first[new]], keys[new])
        unit = np.array([self.known[k] for k in listed])[inverse]
        counts = self.joined[unit + 1] - self.joined[unit]
        upto = np.concatenate(([0], np.cumsum(counts)))
        where = np.arange(upto[-1]) - np.repeat(upto[:-1] - self.joined[unit], counts)
        return self.flat[0][where], upto[np.searchsorted(begin, bounds)]

    def decode(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts, and where each begins; the space that encoding puts first is taken off."""
        tokens = tokens.astype(np.int64)
        sizes = self.raw_at[tokens + 1] - self.raw_at[tokens]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        out = self.raw[np.arange(upto[-1]) - np.repeat(upto[:-1] - self.raw_at[tokens], sizes)]
        bounds = upto[offsets]
        if not self.prefix:
            return out, bounds
        drop = bounds[:-1][(np.diff(bounds) > 0)]
        drop = drop[out[drop] == 0x20]
        kept = np.ones(len(out), bool)
        kept[drop] = False
        return out[kept], bounds - np.searchsorted(drop, bounds)


_ENCODERS: dict = {}


def _encoder(pieces: Pieces) -> Encoder:
    if pieces.key not in _ENCODERS:
        _ENCODERS[pieces.key] = Encoder(pieces)
    return _ENCODERS[pieces.key]


def _texts(array: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in array.to_pylist()]


def encoder(path: str = MODEL):
    """A column function: text as binary -> struct(ids, exact); exact tells that decoding gives the text back."""
    pieces = Pieces(path)

    def encode(text: pa.Array) -> pa.Array:
        e = _encoder(pieces)
        ids, exact, bounds = [], [], []
        step = 256
        for s in range(0, len(text), step):
            part = text[s : s + step]
            tokens, at = e.encode(_texts(part))
            back, back_at = e.decode(tokens, at)
            data, data_at = buffers(part)
            exact.append([np.array_equal(data[a:b], back[c:d]) for a, b, c, d in zip(data_at, data_at[1:], back_at, back_at[1:], strict=False)])
            ids.append(tokens)
            bounds.append(np.diff(at))
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        at = np.concatenate(([0], np.cumsum(np.concatenate(bounds)))) if bounds else np.zeros(1)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array([x for xs in exact for x in xs], pa.bool_())], ["ids", "exact"])

    return F.arrow_udf(encode, "struct<ids array<int>, exact boolean>")


def decoder(path: str = MODEL):
    """A column function: ids -> text. Null is the empty text."""
    pieces = Pieces(path)

    def decode(ids: pa.Array) -> pa.Array:
        e = _encoder(pieces)
        out = []
        for row in ids:
            tokens = np.array(row.as_py() or [], np.int64)
            data, _ = e.decode(tokens, np.array([0, len(tokens)]))
            out.append(data.tobytes().decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return F.arrow_udf(decode, "string")


def encoded(documents: DataFrame, path: str = MODEL, out: str = "pieces") -> DataFrame:
    """`documents` with struct(ids, exact) of each text."""
    small_batches(documents.sparkSession, 4 << 20)
    return documents.withColumn(out, encoder(path)(F.col("text").cast("binary")))


def token_report(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """Per document: its tokens, their number, and whether they decode to the text."""
    rows = encoded(documents.select("doc_id", "text"), path)
    return rows.select(
        "doc_id", F.size("pieces.ids").cast("long").alias("n_tokens"), F.col("pieces.exact").alias("round_trip"), F.col("pieces.ids").alias("token_ids")
    )
