"""N-gram Jaccard join: a grouped prefix join over the word shingles of whole texts.

Method. Every text is a set of 64-bit shingle hashes. Equal sets fall together first (one node per distinct set). All
shingles have one global order, rarest first by a count sketch over all documents; two sets of Jaccard 0.8 share one of
their first n - ceil(0.8 n) + 1 shingles in any such order. Sets with the same prefix and size form a group; groups meet
on shared prefix shingles; runs of one group end there. The rest is expanded to members and verified on the whole sets.

A run of k members does not become k * k pairs: two rounds compare each member with a few hubs of its run, the components
found so far skip what they already hold, and a last round compares every pair across components that passes the exact
size and position bounds and the parity bound: each set carries the parities of its shingles in MARKS places, and two sets
differ in no more places than in shingles. So no link between components is lost, and texts that share a passage but not
enough of the rest make no pairs.

Sets are told apart by 128-bit prints. Nodes carry one half as their number; where two prints share that half (some hundred
times among 1e11 sets) the print gets another number, from a table that all passes are given.

Defined results: null or wordless texts have an empty set (n_shingles 0) and link with nothing; fewer than five words are
one shingle; repeated rows come back once each; a null doc_id keeps its row and takes its component's smallest id, if any.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.arrowtext import U, mix, shingle_sets, tidy
from quarry.llm.components import connected_components
from quarry.llm.scratch import Scratch

#: Buckets of the count sketch that orders shingles: a fixed size, whatever the corpus.
SKETCH_BITS, SKETCH_PARTS = 21, 64
#: Bits of the filter that spares sets without a candidate partner the shuffle.
BLOOM_LEAST, BLOOM_MOST = 20, 28
#: Hubs that each member of a run is compared with in a round, before what is left is compared with every other.
HUBS = 6
#: Prints that share a half and are renamed; about n * n / 2 ** 65 are expected among n sets.
MOST_CLASHES = 1 << 20
#: Bytes of sets that a worker gathers before it hands them on.
SET_BYTES = 4 << 20
#: Places of the parities, a multiple of 64.
MARKS = 1024


def prints(keys: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A print of a set: `bits` bits that number it, 64 more that tell apart what these do not."""
    a = int(mix(np.asarray([keys.sum(dtype=U) + U(len(keys))], U))[0].view(np.int64))
    return a >> (64 - bits), int(mix(keys ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U).view(np.int64))


def parities(s: np.ndarray) -> bytes:
    """Whether the number of a set's shingles that hash to each of MARKS places is odd."""
    return np.packbits(np.bincount((s >> U(40) & U(MARKS - 1)).astype(np.int64), minlength=MARKS).astype(np.uint8) & 1).tobytes()


def renamed(nodes: DataFrame) -> dict[tuple[int, int], int]:
    """New numbers for the prints (gid, hi) that share their gid with others: a small table, whose size is checked."""
    shared = nodes.groupBy("gid").agg(F.min("hi").alias("least"), F.max("hi").alias("most")).where("least < most")
    rows = nodes.join(shared, "gid", "left_semi").select("gid", "hi").distinct().limit(MOST_CLASHES + 1).collect()
    if len(rows) > MOST_CLASHES:
        raise ValueError("more prints share a half than the table of new numbers may hold")
    return {(r.gid, r.hi): int(mix(mix(np.asarray([r.gid], np.int64).view(U)) + np.asarray([r.hi], np.int64).view(U))[0].view(np.int64)) for r in rows}


def _least_overlap_prefix(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def _count(counts: np.ndarray, seen: list[np.ndarray]) -> None:
    if seen:
        counts += np.bincount((np.concatenate(seen) & U(len(counts) - 1)).astype(np.int64), minlength=len(counts)).astype(np.uint32)


def _survey(width: int, bits: int):
    """Pass 1: each text's size and print, and this task's share of the shingle counts."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            n, lo, hi, seen, wait = [], [], [], [], 0
            for _, s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                a, b = prints(s, bits)
                lo.append(a)
                hi.append(b)
                seen.append(s)
                wait += len(s)
                if wait > 1 << SKETCH_BITS:
                    _count(counts, seen)
                    seen, wait = [], 0
            _count(counts, seen)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["doc_id", "n", "gid", "hi", "part", "counts"])
        if counts.any():
            parts = np.minimum(counts, 65535).astype(np.uint16).reshape(SKETCH_PARTS, -1)
            none = pa.nulls(SKETCH_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "n", "gid", "hi", "part", "counts"])

    return run


def _add_up(pdf):
    import pandas as pd

    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
    for x in pdf["counts"]:
        total += np.frombuffer(x, np.uint16)
    rank = np.minimum(8 * np.log2(total + 1.0), 255).astype(np.uint8)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "ranks": [rank.tobytes()]})


def _ordered(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Shingles as sort keys: rarest first, then by hash."""
    return np.sort((ranks[(s & U((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(U) << U(56)) | (s >> U(8)))


def _prefixes(width: int, percent: int, ranks, bits: int, new: dict):
    """Pass 2: the prefix tokens of each group, and its members; what a task has said it does not repeat."""

    def run(batches):
        told: set[tuple[int, int]] = set()
        table = np.frombuffer(ranks.value, np.uint8)
        for batch in batches:
            token, group, pos, node, size = [], [], [], [], []
            member_group, member_node, member_size, marks = [], [], [], []
            for _, s in shingle_sets(batch.column("text"), width):
                if not len(s):
                    continue
                own = prints(s, bits)
                if own in told:
                    continue
                told.add(own)
                head = _ordered(s, table)[: _least_overlap_prefix(len(s), percent)]
                low, high = prints(head)
                key = int(mix(np.asarray([low], np.int64).view(U) + U(len(s)))[0].view(np.int64))
                member_group.append(key)
                member_node.append(new.get(own, own[0]))
                member_size.append(len(s))
                marks.append(parities(s))
                if (key, high) not in told:  # groups that share a key share their tokens: more candidates, none lost
                    told.add((key, high))
                    token.append(head.view(np.int64))
                    group.append(np.full(len(head), key, np.int64))
                    pos.append(np.arange(len(head), dtype=np.int32))
            if not member_group:
                continue
            token, group, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (token, group, pos))
            k, m = len(token), len(member_group)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(token, pa.int64()), pa.nulls(m, pa.int64())]), pa.array(np.concatenate([group, np.asarray(member_group, np.int64)]), pa.int64()), pa.array(np.concatenate([pos, np.zeros(m)]).astype(np.int32), pa.int32()),
                pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(member_node, pa.int64())]), pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(member_size, pa.int64())]),
                pa.ListArray.from_arrays(np.concatenate([np.zeros(k + 1), np.arange(1, m + 1) * (MARKS // 64)]).astype(np.int32), pa.array(np.frombuffer(b"".join(marks), np.int64))),
            ], names=["token", "grp", "pos", "gid", "n", "marks"])

    return run


def _bloom_part(bits: int):
    def run(batches):
        own = np.zeros(1 << (bits - 3), np.uint8)
        some = False
        for batch in batches:
            h = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)) & U((1 << bits) - 1)
            np.bitwise_or.at(own, (h >> U(3)).astype(np.int64), (1 << (h & U(7))).astype(np.uint8))
            some = some or len(h) > 0
        if some:
            parts = own.reshape(SKETCH_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    return run


def _any_of(pdf):
    import pandas as pd

    total = np.frombuffer(pdf["counts"].iloc[0], np.uint8).copy()
    for x in pdf["counts"].iloc[1:]:
        total |= np.frombuffer(x, np.uint8)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "ranks": [total.tobytes()]})


def _sets(width: int, bloom_bits: int, bloom, bits: int, new: dict):
    """Pass 3: whole sets of the nodes that have a candidate partner (or look so)."""

    def run(batches):
        told: set[int] = set()
        table = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            gid, sets, size = [], [], 0
            for _, s in shingle_sets(batch.column("text"), width):
                if not len(s):
                    continue
                own = prints(s, bits)
                g = new.get(own, own[0])
                h = int(mix(np.asarray([g], np.int64).view(U))[0]) & ((1 << bloom_bits) - 1)
                if not table[h >> 3] >> (h & 7) & 1 or g in told:
                    continue
                told.add(g)
                gid.append(g)
                sets.append(s.tobytes())
                size += s.nbytes
                if size > SET_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(sets, pa.binary())], names=["gid", "members"])
                    gid, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(sets, pa.binary())], names=["gid", "members"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def _joined_parts(df: DataFrame, fold) -> bytes:
    """The fixed-size array whose parts the tasks sent; its size is a parameter, not the corpus."""
    rows = df.groupBy("part").applyInPandas(fold, "part int, ranks binary").collect()
    return b"".join(bytes(r.ranks) for r in sorted(rows, key=lambda r: r.part))


def similar(nx: str, ny: str, px: str, py: str, percent: int):
    """Bounds that a pair of Jaccard >= percent meets at the first prefix token that it shares."""
    a, b = F.col(nx), F.col(ny)
    rest = 1 + F.least(a - F.col(px) - 1, b - F.col(py) - 1)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * rest >= percent * (a + b))


def _verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch, width: int, percent: int, bits: int, new: dict) -> DataFrame:
    """pairs(a, b) with ok: whether the whole sets pass. Only sets that a pair asks for leave the texts.

    A hot hub's rows stream past its one set; AQE splits them.
    """
    spark = docs.sparkSession
    pairs = scratch.keep(pairs)
    asked = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct())
    n = asked.count()
    wide = max(BLOOM_LEAST, min(BLOOM_MOST, (16 * n + 1).bit_length()))
    bloom = spark.sparkContext.broadcast(_joined_parts(asked.mapInArrow(tidy(_bloom_part(wide)), "part int, counts binary"), _any_of) or bytes(1 << (wide - 3)))
    sets = scratch.keep(docs.mapInArrow(tidy(_sets(width, wide, bloom, bits, new)), "gid long, members binary")) if n else spark.createDataFrame([], "gid long, members binary")
    one = sets.dropDuplicates(["gid"])
    x, y = one.select(F.col("gid").alias("a"), F.col("members").alias("x")), one.select(F.col("gid").alias("b"), F.col("members").alias("y"))
    done = scratch.keep(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(_verify(percent)), "a long, b long, ok boolean"))
    for used in (pairs, asked, sets) if n else (pairs, asked):
        scratch.drop(used)
    scratch.release()
    return done


def _star_pairs(runs: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a run that spans components, with a few hubs of its run (each a minimum, so nothing is gathered)."""
    hubs = [F.min(F.struct(F.xxhash64("gid", F.lit(turn * HUBS + i)).alias("h"), "gid", "n", "pos", "label")).alias(f"hub{i}") for i in range(HUBS)]
    hub = runs.groupBy("token").agg(*hubs, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    fields = [F.struct(*(F.col(f"hub{i}.{c}").alias(f"h{c}") for c in ("gid", "n", "pos", "label"))) for i in range(HUBS)]
    hub = hub.select("token", F.explode(F.array_distinct(F.array(*fields))).alias("hub")).select("token", "hub.*")
    near = runs.join(hub, "token").where("label <> hlabel").where(similar("n", "hn", "pos", "hpos", percent))
    return near.select(F.least("gid", "hgid").alias("a"), F.greatest("gid", "hgid").alias("b")).distinct()


def _cross_pairs(runs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Every pair of a run across components that passes the bounds: one side is always outside the run's main component."""
    main = runs.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    main = main.where("labels > 1").select("token", F.col("top.label").alias("main"))
    all_ = runs.join(main, "token").join(marks, "gid")
    few = all_.where("label <> main").select("token", F.col("gid").alias("g"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("label").alias("other"), F.col("marks").alias("own"))
    differ = F.aggregate(F.zip_with("marks", "own", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    near = few.join(all_, "token").where("label <> other and (label = main or g < gid)").where(similar("n", "m", "pos", "q", percent) & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("m"))))
    return near.select(F.least("gid", "g").alias("a"), F.greatest("gid", "g").alias("b")).distinct()


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, star_rounds: int = 2, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text). bits: of a set's number; fewer only in tests."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = scratch.keep(docs.mapInArrow(tidy(_survey(width, bits)), "doc_id long, n long, gid long, hi long, part int, counts binary"))
    nodes = scratch.keep(survey.where("part is null").select("doc_id", "n", "gid", "hi"))
    ranks = spark.sparkContext.broadcast(_joined_parts(survey.where("part is not null").select("part", "counts"), _add_up) or bytes(1 << SKETCH_BITS))
    scratch.drop(survey)
    new = renamed(nodes)
    if new:
        names = spark.createDataFrame([(*k, v) for k, v in new.items()], "gid long, hi long, own long")
        nodes = nodes.join(F.broadcast(names), ["gid", "hi"], "left").select("doc_id", "n", F.coalesce("own", "gid").alias("gid"))

    heads = docs.mapInArrow(tidy(_prefixes(width, percent, ranks, bits, new)), "token long, grp long, pos int, gid long, n long, marks array<long>")
    meeting = Window.partitionBy(F.coalesce("token", "grp"), F.col("token").isNull())
    own = F.when(F.col("token").isNull(), F.col("gid")).otherwise(F.col("grp"))
    heads = scratch.keep(heads.withColumn("several", F.min(own).over(meeting) < F.max(own).over(meeting)).where("token is null or several"))
    members = heads.where("token is null").select("grp", "gid", "n", "several").distinct()
    met = heads.where("token is not null").select("token", "grp", "pos").distinct()
    alike = members.where("several").select(F.col("grp").alias("token"), "gid", "n", F.lit(0).alias("pos"))
    runs = scratch.keep(met.join(members, "grp").select("token", "gid", "n", "pos").unionByName(alike))
    marks = scratch.keep(heads.where("token is null").select("gid", "marks").dropDuplicates(["gid"]).join(runs.select("gid").distinct(), "gid", "left_semi"))
    scratch.drop(heads)
    scratch.release()

    tried = links = roots = None
    for turn in range(star_rounds + 1):
        labelled = runs.withColumn("label", F.col("gid")) if roots is None else runs.join(roots, runs.gid == roots.node, "left").select("token", "gid", "n", "pos", F.coalesce("root", "gid").alias("label"))
        pairs = _star_pairs(labelled, turn, percent) if turn < star_rounds else _cross_pairs(labelled, marks, percent)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        done = _verified(docs, pairs, scratch, width, percent, bits, new)
        tried = done.select("a", "b") if tried is None else tried.unionByName(done.select("a", "b"))
        good = done.where("ok").select("a", "b")
        links = good if links is None else links.unionByName(good)
        roots = connected_components(links, scratch)

    placed = nodes.join(roots, nodes.gid == roots.node, "left").select("doc_id", "n", F.coalesce("root", "gid").alias("root"))
    least = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = placed.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
