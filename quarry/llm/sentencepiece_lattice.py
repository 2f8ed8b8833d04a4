"""SentencePiece encoding and decoding by a relational lattice.

Units. Between two characters that no piece can stand across (Joints) every path has a cut, so the best path
of a text is the best paths of its units, the stretches between such cuts, one after another.

Pieces. A piece that scores less than the best path through its own parts is on no best path of any text; such pieces are
left out of the lattice, which changes no result.

Lattice. Distinct units explode into substrings no longer than the longest piece, which meet the piece table by equi-join
on a 64-bit hash, the strings being compared after it (a table of at most MOST_PIECES rows, broadcast); a character that
is no piece stays as bytes (byte fallback). The edges are grouped by unit, sorted by their end and length, and a
higher-order aggregate folds Viterbi over them: the path of the largest sum of piece scores, the shorter last piece among
equals. Its state holds the scores of as many positions as a piece is long. A unit of more than WINDOW characters goes in
windows, whose edges are grouped each for itself and folded one after another, so a run of a million characters is linear
work. That is the search of unigram models. On a vocabulary whose scores are merge ranks (BPE) it is the best path under
these scores and may differ from what greedy merging gives.

Texts. Blocks of documents, bounded in rows and characters, are cut into distinct words and units and shuffled once. Units
that are frequent in a bounded sample of documents are encoded first and kept as a dictionary of at most HOT_UNITS
entries, only to move less: the units that a block has besides go through the same lattice, distinct over all documents,
and come back to their block. No text is cut and no unit is left out.

Defined results: null and empty texts have no ids; every valid text decodes to itself (a literal U+2581 goes as bytes);
repeated rows come back once each; a null doc_id too; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from quarry.llm.arrowtext import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_PIECES, HOT_UNITS, HOT_LENGTH, SAMPLE_DOCS = 1 << 20, 1 << 18, 64, 12288
#: Documents and characters of a block, documents of a partition of blocks, positions of a window of a long unit, tokens
#: and characters that Python works on at once.
BLOCK_DOCS, BLOCK_CHARS, DOCS_A_PART, WINDOW, TOKENS, LIST_CHARS = 4096, 4 << 20, 4096, 512, 1 << 18, 1 << 20
WORD = re.compile(r" *[^ \n]+| +|\n")
#: Places where a word ends whatever comes before it.
BETWEEN = re.compile(r"(?<=[^ \n])(?=[ \n])|(?<=\n)")
#: Entries of a block's list: units, names of long units, windows of these.
_SHORT, _LONG, _WINDOW = "(length(unit) = 1 or not startswith(unit, '\n'))", "length(unit) = 65 and startswith(unit, '\n')", "length(unit) > 65 and startswith(unit, '\n')"
SPACE = "▁"


class Vocabulary:
    """Pieces (spaces for U+2581), their ids and scores, and the ids of bytes."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(len(p) for p, _, _ in pieces)
        self.unknown = min((s for _, _, s in pieces if s > -1e8), default=0.0) - 10.0
        self.useful = [x for x in pieces if len(x[0]) == 1 or self._parts(x[0]) <= x[2] + 1e-9 * abs(x[2])]
        self.reach = max(len(p) for p, _, _ in self.useful)
        self.joints = Joints([p for p, _, _ in self.useful])
        if len(pieces) > MOST_PIECES or self.reach > 63 or any("\0" in p for p, _, _ in pieces) or any(re.search(r"[^ ] |.\n|\n.", p, re.S) for p, _, _ in pieces):
            raise ValueError("a vocabulary whose pieces cross words, or too large a one")
        if len({xxhash.xxh64_intdigest(p.encode(), 42) for p, _, _ in pieces}) < len(pieces):
            raise ValueError("pieces that are the same, or whose hashes are")

    def _parts(self, piece: str) -> float:
        """The score of the best path through a piece's text that is not the piece itself."""
        table, best = self.table(), [0.0]
        for end in range(1, len(piece) + 1):
            options = [best[end - 1] + table.get(piece[end - 1], (0, self.unknown))[1]]
            options += [best[at] + table[piece[at:end]][1] for at in range(end - 1) if end - at < len(piece) and piece[at:end] in table]
            best.append(max(options))
        return best[-1]

    @staticmethod
    @cache
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        odd = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        return Vocabulary([(sp.id_to_piece(i).replace(SPACE, " "), i, sp.get_score(i)) for i in ids if i not in odd], byte_ids)

    @cache  # noqa: B019
    def table(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for p, i, s in self.pieces}

    def texts(self) -> dict[int, bytes]:
        return {i: p.encode() for p, i, _ in self.pieces} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


def words_of(text: str | None) -> list[str]:
    """Stretches of a text that no piece crosses: spaces with the word after them, line breaks."""
    return WORD.findall(" " + text) if text else []


class Joints:
    """Where a piece may stand across two characters: a piece of just these two, or one that holds them with a third.

    Held as marks by hash: what is marked for another's sake only leaves a unit longer, which changes no path.
    """

    def __init__(self, pieces: list[str]):
        two, three = [p for p in pieces if len(p) == 2], [p[i : i + 3] for p in pieces for i in range(len(p) - 2)]
        self.two, self.three = np.zeros(1 << 18, bool), np.zeros(1 << 22, bool)
        for table, names, find in ((self.two, two, self.pairs), (self.three, three, self.triples)):
            if names:
                c = self.characters("".join(names))
                table[find(c)[:: len(names[0])]] = True

    @staticmethod
    def characters(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    @staticmethod
    def pairs(c: np.ndarray) -> np.ndarray:
        return (c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)) >> np.uint32(14)

    @staticmethod
    def triples(c: np.ndarray) -> np.ndarray:
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        return (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(10)

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """(units of all words, in order; how many each word has)."""
        flat = "".join(words)
        c, ends = self.characters(flat), np.cumsum([len(w) for w in words])
        held = np.zeros(len(c) + 1, bool)  # no unit ends before this character
        if len(c) > 1:
            held[1:-1] = self.two[self.pairs(c)]
        if len(c) > 2:
            three = self.three[self.triples(c)]
            inner = ends[:-1]
            three[inner[inner < len(c) - 1] - 1] = False  # two words
            three[inner[inner > 1] - 2] = False
            held[1:-2] |= three
            held[2:-1] |= three
        held[ends] = False
        none = np.flatnonzero(c == 0)  # a unit of its own: it parts units in lists
        held[none] = held[none + 1] = False
        starts = np.flatnonzero(~held[:-1])
        edges = [*starts.tolist(), len(flat)]
        return [flat[i:j] for i, j in itertools.pairwise(edges)], np.diff(np.searchsorted(starts, ends), prepend=0)


def stretches(text: str | None) -> Iterator[str]:
    """A text, with the space that encoding puts first, between words in stretches of bounded size; a longer word is whole."""
    text, at = f" {text}" if text else "", 0
    while len(text) - at > LIST_CHARS and (m := BETWEEN.search(text, at + LIST_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class _Numbers(dict):
    """Numbers of words, which get them as they come; lead is what the word has before the key."""

    def __init__(self, names: list[str], lead: str):
        super().__init__()
        self.names, self.lead = names, lead

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self.names)
        self.names.append(self.lead + key)
        return n


class Words:
    """The distinct words of texts, and texts as numbers of words: words_of(), by splitting at single spaces where it can."""

    def __init__(self):
        self.names: list[str] = []
        self.plain, self.spaced = _Numbers(self.names, ""), _Numbers(self.names, " ")

    def numbers(self, text: str | None) -> np.ndarray:
        plain, spaced, out = self.plain, self.spaced, []
        for stretch in stretches(text):
            for k, line in enumerate(stretch.split("\n")):
                if k:
                    out.append(plain["\n"])
                if "  " in line or line[-1:] == " ":
                    out += [spaced[w[1:]] if w[0] == " " and w[1:2] not in ("", " ") else plain[w] for w in WORD.findall(line)]
                elif line:
                    parts = line.split(" ")
                    if parts[0]:
                        out.append(plain[parts[0]])
                    out.extend(map(spaced.__getitem__, parts[1:]))
        return np.array(out, np.int32)


def _edges(windows: DataFrame, keys: list[str], vocabulary: Vocabulary) -> DataFrame:
    """keys, edges: all edges that end in a window (text after `skip` characters), by their end and length."""
    table = windows.sparkSession.createDataFrame(vocabulary.useful, "name string, id int, score double").withColumn("h", F.xxhash64("name"))
    spans = windows.select(*keys, "skip", "text", F.explode(F.expr("sequence(skip + 1, length(text))")).alias("at"))
    spans = spans.select(*keys, "skip", "text", "at", F.explode(F.expr(f"sequence(1, least({vocabulary.reach}, at))")).alias("len"))
    spans = spans.select(*keys, ((F.col("at") - F.col("skip")) * 64 + F.col("len")).alias("k"), F.substr("text", F.expr("at - len + 1"), "len").alias("piece")).withColumn("h", F.xxhash64("piece"))
    # hashes of pieces are distinct (Vocabulary); a hash that another substring shares finds no piece
    found, same = spans.join(F.broadcast(table), "h", "left").where("k % 64 = 1 or name = piece"), F.col("name") == F.col("piece")
    code, score = F.coalesce(F.when(same, F.col("id")), -1 - F.ascii("piece")), F.coalesce(F.when(same, F.col("score")), F.lit(vocabulary.unknown))
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", code.alias("i"), score.alias("s")))).alias("edges"))


# Viterbi's state. r: scores of the best paths to the last finished positions, as many as a piece is long; b, x: score and
# last edge of the best path to the position in hand; out: last edges of the finished positions of this window.
_EDGE = "struct<k:int,i:int,s:double>"
_START = f"named_struct('r', cast(array() as array<double>), 'b', 0D, 'x', cast(null as {_EDGE}), 'out', cast(array() as array<{_EDGE}>))"


def _forward(edges: Column, start: Column, reach: int) -> Column:
    """The fold over a window's edges. Every position begins with its single character, which finishes the one before."""

    def step(a, x):
        past = F.concat(F.when(F.size(a["r"]) < reach, a["r"]).otherwise(F.slice(a["r"], 2, reach - 1)), F.array(a["b"]))
        new = F.struct(past.alias("r"), (a["b"] + x["s"]).alias("b"), x.alias("x"), F.concat(a["out"], F.array(a["x"])).alias("out"))
        far = F.get(a["r"], F.size(a["r"]) - x["k"] % 64) + x["s"]
        better = F.struct(a["r"].alias("r"), far.alias("b"), x.alias("x"), a["out"].alias("out"))
        return F.when(x["k"] % 64 == 1, new).when(far > a["b"], better).otherwise(a)

    return F.aggregate(edges, start, step)


def _backward(path: Column, start: Column) -> Column:
    """skip, codes: the codes of the best path, last first, along the last edges of all positions, last first."""

    def step(a, x):
        taken = F.struct((x["k"] % 64 - 1).alias("skip"), F.concat(a["codes"], F.array(x["i"])).alias("codes"))
        return F.when(x.isNull(), a).when(a["skip"] == 0, taken).otherwise(F.struct((a["skip"] - 1).alias("skip"), a["codes"].alias("codes")))

    return F.aggregate(path, start, step)


_NONE = "named_struct('skip', 0, 'codes', cast(array() as array<int>))"


def lattice(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """unit, codes array<int> for distinct units(unit), kept in their partitions; -1 - c is a character c that is no piece."""
    found = _edges(units.select("unit", F.lit(0).alias("skip"), F.col("unit").alias("text")), ["unit"], vocabulary)
    last = found.select("unit", _forward(F.col("edges"), F.expr(_START), vocabulary.reach).alias("f")).select("unit", F.reverse(F.concat("f.out", F.array("f.x"))).alias("path"))
    return last.select("unit", F.reverse(_backward(F.col("path"), F.expr(_NONE))["codes"]).alias("codes"))


def long_lattice(windows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """unit, codes of long units(unit, w, skip, text): edges are grouped by window, windows are folded one after another.

    A fold within a fold: what a window adds to the state is put aside when the next one begins, so the state stays small.
    """
    found = _edges(windows, ["unit", "w"], vocabulary).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("w", "edges"))).alias("windows"))
    start = F.expr(f"named_struct('f', {_START}, 'outs', cast(array() as array<array<{_EDGE}>>))")

    def window(a, w):
        f = a["f"]
        kept = F.struct(f["r"].alias("r"), f["b"].alias("b"), f["x"].alias("x"), F.slice(f["out"], 1, 0).alias("out"))
        return F.struct(_forward(w["edges"], kept, vocabulary.reach).alias("f"), F.concat(a["outs"], F.array(f["out"])).alias("outs"))

    last = found.select("unit", F.aggregate("windows", start, window, lambda a: F.reverse(F.concat(a["outs"], F.array(a["f"]["out"]), F.array(F.array(a["f"]["x"]))))).alias("paths"))
    begin = F.expr(f"named_struct('f', {_NONE}, 'outs', cast(array() as array<array<int>>))")

    def back(a, path):
        left = F.struct(a["f"]["skip"].alias("skip"), F.slice(a["f"]["codes"], 1, 0).alias("codes"))
        return F.struct(_backward(F.reverse(path), left).alias("f"), F.concat(a["outs"], F.array(a["f"]["codes"])).alias("outs"))

    return last.select("unit", F.aggregate("paths", begin, back, lambda a: F.reverse(F.flatten(F.concat(a["outs"], F.array(a["f"]["codes"]))))).alias("codes"))


def _flat_ids(codes: np.ndarray, ends: np.ndarray, byte_ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes as ids, with their ends; -1 - c becomes the bytes of character c."""
    odd = np.flatnonzero(codes < 0)
    if not len(odd):
        return codes.astype(np.int32), ends
    told = [[byte_ids[b] for b in chr(-1 - c).encode("utf-8", "replace")] for c in codes[odd].tolist()]
    sizes = np.ones(len(codes), np.int64)
    sizes[odd] = [len(t) for t in told]
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(codes, sizes).astype(np.int32)
    for i, t in zip(at[odd].tolist(), told, strict=True):
        out[i : i + len(t)] = t
    return out, at[ends]


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches `pick` of pool, one after another; the end of each)."""
    own = sizes[pick]
    ends = np.cumsum(own)
    if not len(ends):
        return pool[:0], ends
    return pool[np.repeat(starts[pick] - (ends - own), own) + np.arange(ends[-1])], ends


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends of the lists) of an array of lists."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(at[0], at[-1] - at[0]), at[1:] - at[0]


def _planes(*arrays: np.ndarray) -> list[tuple[bytes, int]]:
    """Whole numbers byte by byte, first bytes first: small numbers compress well."""
    return [(np.ascontiguousarray(a, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), len(a)) for a in arrays]


def _escaped(a: np.ndarray) -> list[tuple[bytes, int]]:
    """Whole numbers as bytes, those below 255 in one; the others are named by 255 and stand in planes."""
    large = a >= 255
    return [(np.where(large, 255, a).astype(np.uint8).tobytes(), len(a)), *_planes(a[large] - 255)]


def _unescaped(parts: list[tuple[bytes, int]]) -> np.ndarray:
    out = np.frombuffer(parts[0][0], np.uint8).astype(np.int64)
    out[out == 255] = _unplaned(parts[1:])[0] + 255
    return out


def _unplaned(parts: list[tuple[bytes, int]]) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<i4").reshape(n).astype(np.int64) for raw, n in parts]


def _count_units(joints: Joints):
    def run(batches):
        from collections import Counter

        for batch in batches:
            words, counts = Words(), np.zeros(0, np.int64)
            for t in batch.column("text"):
                own = np.bincount(words.numbers(t.as_py()), minlength=len(counts))
                own[: len(counts)] += counts
                counts = own
            seen: Counter = Counter()
            units, sizes = joints.cut(words.names) if words.names else ([], np.zeros(0, int))
            for u, n in zip(units, np.repeat(counts, sizes).tolist(), strict=True):
                if len(u) <= HOT_LENGTH:
                    seen[u] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])

    return run


_dictionaries: dict[str, dict[str, int]] = {}


def _dictionary(shared, key: str) -> dict[str, int]:
    """The places of frequent units in the dictionary, made once per worker."""
    if key not in _dictionaries:
        _dictionaries.clear()
        names = shared.value[0]
        own = _dictionaries[key] = {name: i for i, name in enumerate(names.split("\x00") if names else [])}
        own["\0"] = len(own)  # that character parts units in lists, and is a unit of its own, the last of the dictionary
    return _dictionaries[key]


def _named(unit: str) -> str:
    """The name of a long unit; only the line break itself begins with one besides."""
    return "\n" + hashlib.sha256(unit.encode("utf-8", "surrogatepass")).hexdigest()


def _windows(unit: str, reach: int) -> list[str]:
    """A long unit in windows of its positions, each with the characters before it that a piece may begin in."""
    return [f"{_named(unit)}\n{w}\n{min(at, reach - 1)}\n{unit[max(0, at - reach + 1) : at + WINDOW]}" for w, at in enumerate(range(0, len(unit), WINDOW))]


class _Block:
    """Documents that are worked on together: each distinct word is cut once, each distinct unit looked up once."""

    def __init__(self):
        self.words, self.tokens, self.places, self.doc_ids, self.size = Words(), [], [], [], 0

    def add(self, place: int, doc_id: int | None, text: str | None) -> None:
        self.tokens.append(self.words.numbers(text))
        self.places.append(place)
        self.doc_ids.append(doc_id)
        self.size += len(text or "") + 32

    def row(self, hot: dict[str, int], joints: Joints, reach: int, press) -> tuple[bytes, str]:
        """(the documents, packed; units that the dictionary lacks, long ones by name, and then the windows of these)."""
        tokens, names = np.concatenate(self.tokens), self.words.names
        order = np.argsort(-np.bincount(tokens, minlength=len(names)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        units, sizes = joints.cut([names[i] for i in order.tolist()]) if names else ([], np.zeros(0, np.int64))
        seen: dict[str, int] = {}
        flat = np.array([seen.setdefault(u, len(seen)) for u in units], np.int64)
        known = np.array([hot.get(u, -1) for u in seen], np.int64)
        cold = [u for u, i in zip(seen, known.tolist(), strict=True) if i < 0]
        entries = [u if len(u) <= WINDOW else _named(u) for u in cold] + [w for u in cold if len(u) > WINDOW for w in _windows(u, reach)]
        first = flat > np.concatenate([[-1], np.maximum.accumulate(flat)[:-1]])[: len(flat)]
        listed = "\0".join(entries)
        parts = (self.places, self.doc_ids, len(listed), _planes(np.array([len(t) for t in self.tokens]), sizes, np.where(first, 0, flat + 1), known + 1), _escaped(rank[tokens]))
        return press.compress(pickle.dumps(parts, 5)), listed


def _blocks(shared, key: str, joints: Joints, reach: int, block_docs: int, ordered: bool):
    """Rows block, docs, units: each of block_docs documents and BLOCK_CHARS characters at most, or one long document.

    block is the first place, or a number that no other block of the table has.
    """

    def run(batches):
        hot, press = _dictionary(shared, key), zstandard.ZstdCompressor(level=3)
        own, first, last, made = _Block(), 0, None, TaskContext.get().partitionId() << 32

        def done():
            docs, units = own.row(hot, joints, reach, press)
            return pa.RecordBatch.from_arrays([pa.array([first if ordered else made], pa.int64()), pa.array([docs], pa.binary()), pa.array([units], pa.string())], names=["block", "docs", "units"])

        for batch in batches:
            for place, doc_id, text in zip(*(batch.column(c) for c in ("place", "doc_id", "text")), strict=True):
                place, text = place.as_py(), text.as_py()
                if own.places and (len(own.places) >= block_docs or own.size + len(text or "") > BLOCK_CHARS or (ordered and place != last + 1)):
                    yield done()
                    own, made = _Block(), made + 1
                if not own.places:
                    first = place
                own.add(place, doc_id.as_py(), text)
                last = place
        if own.places:
            yield done()

    return run


def _assembled(shared, byte_ids: list[int]):
    """doc_id, ids of the documents of each block, from its packed documents and the codes of its cold units."""

    def run(batches):
        unpress, (_, hot_ends, hot_ids) = zstandard.ZstdDecompressor(), shared.value
        hot_ends = np.concatenate([[0], hot_ends])
        for batch in batches:
            for docs, listed_size, told in zip(batch.column("docs"), batch.column("listed"), batch.column("told"), strict=True):
                places, doc_ids, size, parts, tokens = pickle.loads(unpress.decompress(docs.as_py()))
                n_tokens, sizes, again, known = _unplaned(parts)
                tokens, flat = _unescaped(tokens), np.where(again == 0, np.cumsum(again == 0) - 1, again - 1)
                starts, lengths, pool = hot_ends[known - 1], np.where(known > 0, hot_ends[known] - hot_ends[known - 1], 0), hot_ids
                cold = np.flatnonzero(known == 0)
                if len(cold):
                    listed, stops = _listed(told.values)  # lists of a unit's place and its codes
                    listed, begin = listed.to_numpy(), np.concatenate([[0], stops])[:-1]
                    pos = listed[begin]
                    more, stops = _flat_ids(np.delete(listed, begin), np.concatenate([[0], stops - np.arange(1, len(stops) + 1)]), byte_ids)
                    if len(cold) != len(set(pos.tolist())) or size != listed_size.as_py():
                        raise RuntimeError("a block has not got the ids of all its units")
                    starts[cold[pos]], lengths[cold[pos]] = stops[:-1] + len(pool), np.diff(stops)
                    pool = np.concatenate([pool, more])
                # units of each word, then words of each document
                words, unit_ends = gather(pool, starts, lengths, flat)
                word_ends = np.concatenate([[0], unit_ends])[np.cumsum(sizes)]
                word_sizes = np.diff(word_ends, prepend=0)
                out = [gather(words, word_ends - word_sizes, word_sizes, tokens[i : i + TOKENS])[0] for i in range(0, len(tokens), TOKENS)]
                ends = np.concatenate([[0], np.cumsum(word_sizes[tokens])])[np.concatenate([[0], np.cumsum(n_tokens)])]
                lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())).cast(pa.list_(pa.int32()))
                for i in range(0, len(places), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(places[i : i + 256], pa.int64()), pa.array(doc_ids[i : i + 256], pa.int64()), lists[i : i + 256]], names=["place", "doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str = MODEL, place: str | None = None) -> DataFrame:
    """doc_id, ids array<int> for every row of docs(doc_id, text).

    place: a column of places that rise along docs; it is returned too, and rows come in its order, partition after partition.
    """
    spark, vocabulary = docs.sparkSession, Vocabulary.load(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(place) if place else F.lit(0)).cast("long").alias("place"))
    n = docs.count()
    share = int(min(1.0, SAMPLE_DOCS / max(1, n)) * (1 << 30))
    seen = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) < share).select("text").mapInArrow(tidy(_count_units(vocabulary.joints)), "unit string, n long")
    frequent = seen.groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1 and instr(unit, '\\0') = 0").orderBy(F.desc("n"), "unit").limit(HOT_UNITS).select("unit").repartition(16, "unit")
    known = lattice(frequent, vocabulary).toArrow().combine_chunks()
    codes, ends = _listed(known.column("codes").chunk(0)) if known.num_rows else (pa.array([], pa.int32()), np.zeros(0, np.int64))
    ids, ends = _flat_ids(codes.to_numpy(), np.concatenate([[0], ends]), vocabulary.byte_ids)
    ids, ends = np.append(ids, np.int32(vocabulary.byte_ids[0])), np.append(ends, ends[-1] + 1)  # that of the character 0
    shared = spark.sparkContext.broadcast(("\x00".join(known.column("unit").to_pylist()), ends[1:], ids))
    key = f"{shared._jbroadcast.id()}-{spark.sparkContext.applicationId}"
    del known, codes, ids

    schema = StructType([StructField("block", LongType(), False), StructField("docs", BinaryType()), StructField("units", StringType())])
    blocks = docs.mapInArrow(tidy(_blocks(shared, key, vocabulary.joints, vocabulary.reach, BLOCK_DOCS, place is not None)), schema).repartition("block")
    parts = max(8, n // DOCS_A_PART * 4)
    # The conditions on docs, least and pos hold always. They make all uses of blocks, and both of cold, read the same
    # columns, so that Spark makes each of the two shuffles once.
    listed = blocks.select("block", F.posexplode(F.split(F.when(F.col("docs").isNotNull() & (F.col("units") != ""), F.col("units")), "\\x00")).alias("pos", "unit"))
    cold = listed.where(_SHORT).repartition(parts, "unit")
    made = lattice(cold.groupBy("unit").agg(F.min("block").alias("least"), F.min("pos").alias("pos")).where("least is not null and pos >= 0").select("unit"), vocabulary)
    told = cold.join(made, "unit").select("block", "pos", "codes")
    part = F.split("unit", "\n", 5)  # nothing, name, window, skip, text
    windows = listed.where(_WINDOW).select(F.concat(F.lit("\n"), part[1]).alias("unit"), part[2].cast("int").alias("w"), part[3].cast("int").alias("skip"), part[4].alias("text"))
    windows = windows.repartition(parts, "unit", "w").dropDuplicates(["unit", "w"])
    told = told.unionByName(listed.where(_LONG).join(long_lattice(windows, vocabulary), "unit").select("block", "pos", "codes"))
    told = told.groupBy("block").agg(F.collect_list(F.concat(F.array("pos"), F.col("codes"))).alias("told"))
    whole = blocks.join(told, "block", "left").select("block", "docs", F.length("units").alias("listed"), "told")
    if place is not None:
        whole = whole.repartitionByRange("block").sortWithinPartitions("block")
    out = whole.select("docs", "listed", "told").mapInArrow(tidy(_assembled(shared, vocabulary.byte_ids)), "place long, doc_id long, ids array<int>")
    return out.select(*(["place"] if place else []), "doc_id", "ids")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded(ids, ...) with text added: the pieces' texts, without the space that encoding puts first.

    A null list gives a null text; a null in a list and an id that stands for no text give nothing.
    """
    texts = Vocabulary.load(model).texts()
    sizes = np.zeros(max(texts, default=0) + 2, np.int64)  # the last place: ids that stand for no text
    for i, t in texts.items():
        sizes[i] = len(t)
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(texts[i] for i in sorted(texts)), np.uint8), sizes))
    own = [c for c in encoded.columns if c != "text"]
    encoded = encoded.select(own)

    def run(batches):
        pool, sizes = shared.value
        starts, none = np.cumsum(sizes) - sizes, len(sizes) - 1
        for batch in batches:
            column = batch.column("ids")
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
            at, texts = 0, []
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1)
                ids = pc.fill_null(column.slice(at, to - at).flatten(), -1).to_numpy().astype(np.int64)
                raw, stops = gather(pool, starts, sizes, np.where((ids < 0) | (ids > none), none, ids))
                raw, stops = raw.tobytes(), np.concatenate([[0], stops])[ends[at : to + 1] - ends[at]].tolist()
                texts += [raw[i + 1 : j].decode("utf-8", "replace") if some else None for i, j, some in zip(stops, stops[1:], column.slice(at, to - at).is_valid().to_pylist(), strict=False)]
                at = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*own, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(tidy(run), f"{kinds}, text string")


def encoding_digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids joined by commas), text_sha256 and n_chars of the decoded text."""
    back = decode(encode(docs, model), model)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def best_path(word: str, vocabulary: Vocabulary) -> list[int]:
    """Brute force for tests: Viterbi in plain Python over all pieces and the whole word."""
    table = vocabulary.table()
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]  # score, length and ids of the last piece
    for end in range(1, len(word) + 1):
        options = []
        for size in range(1, min(vocabulary.longest, end) + 1):
            piece, before = word[end - size : end], best[end - size][0]
            if piece in table:
                options.append((before + table[piece][1], -size, [table[piece][0]]))
            elif size == 1:
                options.append((before + vocabulary.unknown, -size, [vocabulary.byte_ids[b] for b in piece.encode()]))
        score, size, ids = max(options, key=lambda o: o[:2])
        best.append((score, -size, ids))
    at, out = len(word), []
    while at:
        out.append(best[at][2])
        at -= best[at][1]
    return [i for ids in reversed(out) for i in ids]
