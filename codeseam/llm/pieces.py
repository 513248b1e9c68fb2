"""SentencePiece BPE encoding with offsets, and decoding.

Normalisation replaces the longest prefixes found in the model's compiled character map and records, for every byte it
makes, the source bytes that byte came from; merged pieces are projected through that record onto byte spans of the
original text.  The map is walked only where some mapped prefix can begin (the first bytes that its trie knows), all
other bytes stand for themselves; every text of every model takes this one way.

Merging works on segments that no piece can cross (checked against the vocabulary when a model is opened), so segments
are encoded once and kept in a bounded table.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeseam.llm.common import kept

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 400_000  # segments in each of two tables
FLUSH_TOKENS = 1_000_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        shift += 7
        if x < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, and the replacement strings."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob) if blob else (0,)
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.strings = blob[4 + size :]
        #: Whether a mapped prefix can begin with a byte.
        self.begins = np.zeros(256, bool)
        if self.units:
            root = self._offset(self.units[0])
            for byte in range(256):
                self.begins[byte] = root ^ byte < len(self.units) and self.units[root ^ byte] & 0x800000FF == byte

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Source length and replacement of the longest mapped prefix at ``at``."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        offset = self._offset
        node = offset(units[0])
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return found


class PieceModel:
    def __init__(self, blob: bytes):
        self.piece_bytes: list[bytes] = []
        self.kinds: list[int] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [-1] * 256
        spec = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
        trainer: dict[int, object] = {}
        self.unk = 0
        for field, value in _fields(blob):
            if field == 1:
                self._piece(dict(_fields(value)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec |= dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        if trainer.get(24, 0):
            raise ValueError("white space as suffix is not supported")
        self.byte_fallback = min(self.byte_ids) >= 0 and bool(trainer.get(35, 0))
        surface = trainer.get(44, " ⁇ ".encode())
        self.unk_surface = surface if isinstance(surface, bytes) else b" \xe2\x81\x87 "
        self.charmap = CharMap(spec[2])
        self.prefix, self.squeeze, self.escape = bool(spec[3]), bool(spec[4]), bool(spec[5])
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.loners = "\n" if "\n" not in joined else ""
        cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        lone = f"{self.loners}+" if self.loners else "(?!)"
        body = f"[^{SPACE}{self.loners}]"
        self.segments = re.compile(f"{SPACE}*{body}+|{SPACE}+|{lone}") if cuts else re.compile("(?s).+")
        self.cuts = cuts
        #: Bytes of a piece in normalised text.
        self.made_len = np.array([1 if k == BYTE else len(b) for b, k in zip(self.piece_bytes, self.kinds)], np.int32)
        self.surface = [
            b.replace(SPACE.encode(), b" ") if k in (NORMAL, BYTE) else (self.unk_surface if k == UNKNOWN else b"")
            for b, k in zip(self.piece_bytes, self.kinds)
        ]
        #: Neighbouring characters that some piece holds; nothing merges across any others.
        self.bigrams = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, f: dict) -> None:
        text = f[1].decode()
        kind = f.get(3, NORMAL)
        at = len(self.kinds)
        self.kinds.append(kind)
        if kind == BYTE:
            value = int(text[3:5], 16)
            self.byte_ids[value] = at
            self.piece_bytes.append(bytes([value]))
        else:
            self.piece_bytes.append(text.encode())
            if kind == UNKNOWN:
                self.unk = at
            if kind in (NORMAL, USER):
                self.ids[text] = at
                self.scores[text] = struct.unpack("<f", f[2])[0] if 2 in f else 0.0

    # ---- merging

    def merge(self, s: str) -> list[str]:
        """Pieces of one segment: the best-scored neighbours join first, the leftmost of equals."""
        scores = self.scores
        parts = list(s)
        n = len(parts)
        if n <= 48:
            get, none = scores.get, float("-inf")
            joins = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            while joins:
                best = max(joins)
                if best == none:
                    break
                i = joins.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del joins[i]
                if i:
                    joins[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(joins):
                    joins[i] = get(parts[i] + parts[i + 1], none)
            return parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = parts[i] + parts[j]
            if (sc := scores.get(joined)) is not None:
                heapq.heappush(heap, (-sc, i, j, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != len(joined) or after[i] != j:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def part_ids(self, s: str) -> list[int]:
        out: list[int] = []
        for p in self.merge(s):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.byte_ids[b] for b in p.encode())
            elif not out or out[-1] != self.unk:  # neighbouring unknowns are one
                out.append(self.unk)
        return out

    def segment_ids(self, s: str) -> bytes:
        """Ids of a segment as packed 32-bit numbers; its parts that nothing merges across are looked up one by one."""
        bigrams = self.bigrams
        cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in bigrams]
        if not cuts or not self.byte_fallback:
            found = np.array(self.part_ids(s), np.int32).tobytes()
        else:
            get, parts = self.cache.get, []
            for a, b in zip([0, *cuts], [*cuts, len(s)]):
                part = s[a:b]
                ids = get(part)
                if ids is None:
                    ids = self.older.get(part)
                    if ids is None:
                        ids = np.array(self.part_ids(part), np.int32).tobytes()
                    if len(part) <= 64:
                        self.keep(part, ids)
                parts.append(ids)
            found = b"".join(parts)
        if len(s) <= 64 and "\n" not in s:
            self.keep(s, found)
        return found

    def keep(self, s: str, found: bytes) -> None:
        """Remember a segment.  A full table becomes the older one; what is met again moves to the new."""
        if len(self.cache) >= CACHE:
            self.older = dict(self.cache)
            self.cache.clear()
        self.cache[s] = found

    def missed(self, s: str) -> bytes:
        found = self.older.get(s)
        if found is None:
            return self.segment_ids(s)
        self.keep(s, found)
        return found

    # ---- normalisation with alignment

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, spaces still spaces, and of each the source bytes [begin, end) that it stands for."""
        raw = np.frombuffer(data, np.uint8)
        made, begin = raw, np.arange(len(raw), dtype=np.int32)
        end = begin + 1
        near = np.nonzero(self.charmap.begins[raw])[0]
        if len(near):
            parts, spans, at = [], [], 0
            for p in near.tolist():
                if p < at or raw[p] & 0xC0 == 0x80 or (hit := self.charmap.longest(data, p)) is None:
                    continue
                size, new = hit
                parts += [raw[at:p], np.frombuffer(new, np.uint8)]
                spans += [(begin[at:p], end[at:p]), (np.full(len(new), p, np.int32), np.full(len(new), p + size, np.int32))]
                at = p + size
            made = np.concatenate([*parts, raw[at:]])
            begin, end = (np.concatenate([*(x[j] for x in spans), own[at:]]) for j, own in enumerate((begin, end)))
        if self.squeeze and len(made):
            space = made == 0x20
            kept = np.nonzero(~(space & np.concatenate([[True], space[:-1]])))[0]
            if len(kept) and space[kept[-1]]:  # nor does a space end the text
                kept = kept[:-1]
            made, begin, end = made[kept], begin[kept], end[kept]
        if self.prefix and len(made):
            made = np.concatenate([[np.uint8(0x20)], made])
            begin, end = np.concatenate([begin[:1], begin]), np.concatenate([begin[:1], end])
        return made.tobytes(), begin, end

    # ---- encoding

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and source byte spans of the whole text."""
        made, begin, end = self.normalise(text.encode())
        if not made:
            none = np.empty(0, np.int32)
            return none, none, none
        norm = made.decode()
        if not self.byte_fallback:
            ids, size = self._with_unknowns(norm)
        else:
            if self.cuts and self.escape and SPACE not in norm and "  " not in norm and norm[0] == " " and norm[-1] != " ":
                segs = norm.replace(" ", " " + SPACE)[1:].split(" ")
            else:
                segs = self.segments.findall(norm.replace(" ", SPACE) if self.escape else norm)
            get, miss = self.cache.get, self.missed
            ids = np.frombuffer(b"".join([get(s) or miss(s) for s in segs]), np.int32)
            size = self.made_len[ids]
        # each byte of the escaped text is one of the normalised bytes; a space is three of it
        of = np.arange(len(made), dtype=np.int32)
        if self.escape:
            of = np.repeat(of, np.where(np.frombuffer(made, np.uint8) == 0x20, 3, 1))
        stop = np.cumsum(size, dtype=np.int64)
        return ids, begin[of[stop - size]], end[of[stop - 1]]

    def _with_unknowns(self, norm: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their bytes where what no piece holds is unknown; neighbouring unknowns are one."""
        ids: list[int] = []
        size: list[int] = []
        for seg in self.segments.findall(norm.replace(" ", SPACE) if self.escape else norm):
            for p in self.merge(seg):
                i = self.ids.get(p, self.unk)
                if i == self.unk and ids and ids[-1] == self.unk:
                    size[-1] += len(p.encode())
                else:
                    ids.append(i)
                    size.append(len(p.encode()))
        return np.array(ids, np.int32), np.array(size, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text of ``ids``; bytes that form no character become U+FFFD each."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        if self.prefix or self.squeeze:
            first = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if first is not None and self.kinds[first] in (NORMAL, USER) and data.startswith(b" "):
                data = data[1:]
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(data):
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                try:
                    data[at : at + size].decode()
                    out.append(data[at : at + size])
                except UnicodeDecodeError:
                    out.append("�".encode())
                    size = 1
                at += size
            return b"".join(out)


def opened(blob: bytes) -> PieceModel:
    """The model of a file's bytes; a worker process keeps the one it has open, and its table of segments, from task to task."""
    return kept("pieces", hash(blob), lambda: PieceModel(blob))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, ids, starts, ends, decoded) per row: all ids, each one's byte span in the original text, and the decoded text.

    Null and empty texts give empty arrays and the empty text.  Repeated rows give repeated rows; a null id stays null.
    ``carry`` names further columns to keep (in front); others are not read.  One named like a result column, whatever the
    case of its letters, takes ``_`` at its end until its name is free.
    """
    with open(model_path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    carry, taken, named = carry or [], {"id", "ids", "starts", "ends", "decoded"}, []
    for c in [*carry, "text"]:
        while c.lower() in taken:
            c += "_"
        taken.add(c.lower())
        named.append(c)
    source = df.select(*(F.col(c).alias(n) for c, n in zip(carry, named)), F.col(id_col).alias("id"), F.col(text_col).alias(named[-1]))
    names, width = source.columns[: len(carry) + 1], len(carry) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sent.value)
        for batch in batches:
            texts = batch.column(width)
            begin, held, parts, decoded, sizes = 0, 0, [], [], []
            for k in range(batch.num_rows):
                ids, starts, ends = model.encode(texts[k].as_py() or "")
                parts.append((ids, starts, ends))
                decoded.append(model.decode(ids.tolist()).decode())
                sizes.append(len(ids))
                held += len(ids)
                if held >= FLUSH_TOKENS or k + 1 == batch.num_rows:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    lists = [
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[j] for p in parts]), pa.int32()))
                        for j in range(3)
                    ]
                    rows = batch.slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns[:width], *lists, pa.array(decoded, pa.string())],
                        names=[*names, "ids", "starts", "ends", "decoded"],
                    )
                    begin, held, parts, decoded, sizes = k + 1, 0, [], [], []

    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    ints = ArrayType(IntegerType(), True)
    schema = StructType(
        [*source.schema.fields[: len(carry) + 1], *(StructField(c, ints) for c in ("ids", "starts", "ends")), StructField("decoded", StringType())]
    )
    return source.mapInArrow(run, schema)


def digests(spark: SparkSession, docs: DataFrame, model_path: str, ids: bool = False) -> DataFrame:
    """The contract's columns from the operator's ids, spans and decoded text, and the ids themselves where asked for."""
    found = encode(docs, model_path)
    return found.select(
        F.col("id").cast("bigint").alias("doc_id"),
        *(["ids"] if ids else []),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("bigint").alias("source_bytes"),
    )
