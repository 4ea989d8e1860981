"""Set-similarity join of documents on word n-grams by rare-first prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.components import components
from loomwork.llm.steps import materialize
from loomwork.llm.words import chunks, mix, shingle_hashes, word_hashes

COUNTERS = 1 << 20  # of the frequency summary that every task gets: one byte each
BLOCK = 1024
TURNS = 6  # with other hubs, at most, before all pairs that are left
WORTH = 20  # a turn that links less than one in so many of its pairs is the last
PARTS = 1024  # of the hash space, for the suffix filter: one bit each
_TOKEN_SHIFT = np.uint64(9)
ROW = ["doc_id", "th", "th2"]  # what tells rows apart: the identifier and the text's hashes
_ROW = "doc_id long, th long, th2 long"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"th": F.xxhash64("text"),
                             "th2": F.xxhash64(F.lit(7), "text", F.lit(7))})


def _same_row(x: str, y: str) -> F.Column:
    """Columns ``ROW`` of both sides are equal, null identifiers too."""
    same = F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id"))
    return same & (F.col(f"{x}.th") == F.col(f"{y}.th")) & (F.col(f"{x}.th2") == F.col(f"{y}.th2"))


def _once(rows: DataFrame, *key: str) -> DataFrame:
    """One row per ``key``, of rows with ``copies``; only repeated ones are shuffled."""
    again = rows.where("copies > 1")
    return rows.where("copies = 1").unionByName(again.dropDuplicates(list(key))).drop("copies")


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every row, sorted."""
    for _, offsets, data in chunks(batch.column("text")):
        words, at = word_hashes(offsets, data)
        for a, b in zip(at[:-1], at[1:]):
            yield np.unique(shingle_hashes(words[a:b], width))


def prefix_length(n: int, num: int, den: int) -> int:
    """Tokens of a set of ``n`` in rare-first order of which similar sets share one."""
    return n - -(-n * num // den) + 1 if n else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _signatures(width: int):
    """Per row its set's size and signature; per task the counts of all its shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*ROW, "n", "sig1", "sig2", "block", "counts"]
        seen = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            n, one, two, pending, held = [], [], [], [], 0
            for found in _sets(batch, width):
                n.append(len(found))
                one.append(_signed(int(mix(found).sum(dtype=np.uint64))))
                two.append(_signed(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(
                    dtype=np.uint64))))
                pending.append(found >> np.uint64(44))
                held += len(found)
                if held > COUNTERS:
                    seen += np.bincount(np.concatenate(pending).astype(np.int64),
                                        minlength=COUNTERS).astype(np.uint32)
                    pending, held = [], 0
            if pending:
                seen += np.bincount(np.concatenate(pending).astype(np.int64),
                                    minlength=COUNTERS).astype(np.uint32)
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ROW), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.nulls(rows, pa.int32()),
                 pa.nulls(rows, pa.binary())], names)
        blocks = [i for i in range(COUNTERS // BLOCK) if seen[i * BLOCK:(i + 1) * BLOCK].any()]
        rows = len(blocks)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(rows, pa.int64()) for _ in range(len(ROW) + 3)),
             pa.array(blocks, pa.int32()),
             pa.array([seen[i * BLOCK:(i + 1) * BLOCK].tobytes() for i in blocks], pa.binary())],
            names)
    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per block; blocks are dealt over tasks and each task keeps running sums."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(),
                                 batch.column("counts").to_pylist()):
            own = sums.setdefault(block, np.zeros(BLOCK, np.uint64))
            own += np.frombuffer(counts, np.uint32)
    levels = [np.minimum(255, np.round(8 * np.log2(1 + s.astype(float)))).astype(np.uint8)
              for s in sums.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()),
         pa.array([x.tobytes() for x in levels], pa.binary())], ["block", "levels"])


def _prefixes(shared, width: int, num: int, den: int):
    """Per row the rarest tokens of its set, in order, and the parity of its size in each part
    of the hash space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            n, one, two, tokens, parts = [], [], [], [], []
            for found in _sets(batch, width):
                n.append(len(found))
                one.append(_signed(int(mix(found).sum(dtype=np.uint64))))
                two.append(_signed(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(
                    dtype=np.uint64))))
                rank = levels[(found >> np.uint64(44)).astype(np.int64)].astype(np.uint64)
                order = (rank << np.uint64(55)) | (found >> _TOKEN_SHIFT)
                keep = prefix_length(len(found), num, den)
                if keep < len(order):
                    order = np.partition(order, keep - 1)[:keep] if keep else order[:0]
                tokens.append(np.sort(order).view(np.int64))
                odd = np.bincount((found & np.uint64(PARTS - 1)).astype(np.int64),
                                  minlength=PARTS) & 1
                parts.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            ends = np.cumsum([0] + [len(t) for t in tokens]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ROW), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))],
                [*ROW, "n", "sig1", "sig2", "tokens", "parts"])
    return run


def _verify(width: int, num: int, den: int):
    """Keep the pairs whose sets, counted in full, are similar."""
    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        return _sets(pa.RecordBatch.from_arrays([column], ["text"]), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(sets(batch.column("text_a")), sets(batch.column("text_b"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())],
                ["a", "b", "linked"])
    return run


def _may_link(x: str, y: str, num: int, den: int) -> F.Column:
    """The suffix filter on columns ``n_x, parts_x, n_y, parts_y``.

    Sets of n and m tokens link if they differ in ``(den - num) * (n + m) / (den + num)``
    tokens at most. In each part of the hash space where one size is odd and the
    other even they differ in one at least.
    """
    odd = [F.bit_count(F.get(f"parts_{x}", F.lit(i)).bitwiseXOR(F.get(f"parts_{y}", F.lit(i))))
           for i in range(PARTS // 64)]
    return sum(odd[1:], odd[0]) * (num + den) <= (F.col(f"n_{x}") + F.col(f"n_{y}")) * (den - num)


class _Join:
    """What the steps of one join share."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, width: int, num: int, den: int):
        self.meta = nodes.select("node", "n", "parts")
        self.texts, self.width, self.num, self.den = texts, width, num, den

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Links among distinct pairs ``(a, b)``: length and suffix filter, then the texts."""
        num, den = self.num, self.den
        side = lambda k: self.meta.select(*[
            F.col(c).alias(k if c == "node" else f"{c}_{k}") for c in ("node", "n", "parts")])
        a, b = side("a"), side("b")
        left = (pairs.join(a, "a").join(b, "b")
                .where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
                .where(_may_link("a", "b", num, den)).select("a", "b"))
        t = self.texts
        full = (left.join(t.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
                .join(t.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
        checked = full.mapInArrow(_verify(self.width, num, den),
                                  "a long, b long, linked boolean")
        return materialize(checked.where("linked").select("a", "b").distinct(), "links")


def _mixed(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings of the tokens that stand in more than one component, with ``comp``."""
    own = (postings.join(comps, "node", "left")
           .withColumn("comp", F.coalesce("component", "node")).drop("component"))
    spread = own.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return materialize(own.join(spread.where("low <> high").select("token"), "token"), "mixed")


def _hub_pairs(mixed: DataFrame, turn: int) -> DataFrame:
    """Each node of a token with the token's hub of this turn, if their components differ."""
    draw = F.xxhash64("node", F.lit(turn))
    hubs = (mixed.groupBy("token").agg(F.min(draw).alias("draw")))
    hub = mixed.select("token", draw.alias("draw"), *[
        F.col(c).alias(f"{c}_h") for c in ("node", "n", "comp")])
    chosen = hub.join(hubs, ["token", "draw"]).drop("draw")
    met = mixed.join(chosen, "token").where("comp <> comp_h")
    return met.select(F.least("node", "node_h").alias("a"),
                      F.greatest("node", "node_h").alias("b")).distinct()


def _crossing(mixed: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share a prefix token and pass the filters.

    Of a token's components the one with most sets is never paired with itself:
    the smaller ones meet it and one another, so a large group that is known to
    belong together costs nothing. The first shared token's positions bound what
    two sets can share.
    """
    sizes = mixed.groupBy("token", "comp").count()
    first = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("count"), "comp"))
    main = sizes.withColumn("r", first).where("r = 1").select("token", F.col("comp").alias("main"))
    tagged = mixed.join(main, "token").join(meta.select("node", "parts"), "node")
    kept = ("node", "n", "at", "comp", "parts")
    x = tagged.where("comp <> main").select(
        "token", *[F.col(c).alias(f"{c}_x") for c in kept])
    y = tagged.select("token", "main",
                      *[F.col(c).alias(f"{c}_y") for c in kept])
    within = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    before = F.least("at_x", "at_y")  # tokens that may be shared before this one
    met = x.join(y, "token").where("comp_x <> comp_y AND (comp_y = main OR comp_y < comp_x)").where(
        (F.least("n_x", "n_y") * den >= F.greatest("n_x", "n_y") * num)
        & ((before + within) * (num + den) >= (F.col("n_x") + F.col("n_y")) * num)
        & _may_link("x", "y", num, den))
    side = lambda k: F.struct(*[F.col(f"{c}_{k}").alias(c) for c in ("node", "n", "at")])
    swap = F.col("node_x") < F.col("node_y")
    pairs = met.select(F.when(swap, side("x")).otherwise(side("y")).alias("p"),
                       F.when(swap, side("y")).otherwise(side("x")).alias("q"))
    firsts = pairs.groupBy(
        F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.n").alias("n_a"),
        F.col("q.n").alias("n_b")).agg(F.min("p.at").alias("at_a"), F.min("q.at").alias("at_b"))
    bound = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return firsts.where(bound * (num + den) >= (F.col("n_a") + F.col("n_b")) * num).select("a", "b")


def _grouped(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per row ``ROW``, ``n`` and ``head``, the first row of its group: ``none, *ROW, copies``."""
    spark = docs.sparkSession
    docs = _keyed(docs.select("doc_id", "text"))
    first = materialize(docs.mapInArrow(
        _signatures(width), f"{_ROW}, n long, sig1 long, sig2 long, block int, counts binary"),
        "signatures")
    rows = first.where("block IS NULL").select(*ROW, "n", "sig1", "sig2")
    key = ["n", "sig1", "sig2"]
    row = F.struct(F.col("doc_id").isNull().alias("none"), *ROW, "copies")
    classes = materialize(
        rows.where("n > 0").groupBy(*key, *ROW).agg(F.count("*").alias("copies"))
        .groupBy(*key).agg(F.min(row).alias("head"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")

    table = np.zeros(COUNTERS, np.uint8)  # fixed size, whatever the input
    counted = (first.where("block IS NOT NULL").select("block", "counts").repartition("block")
               .mapInArrow(_add_blocks, "block int, levels binary"))
    for r in counted.collect():
        table[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["levels"], np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())

    listed = docs.mapInArrow(
        _prefixes(shared, width, num, den),
        f"{_ROW}, n long, sig1 long, sig2 long, tokens array<long>, parts array<long>")
    listed = listed.where("n > 0").alias("l").join(
        classes.alias("c"), key).where(_same_row("l", "c.head"))
    nodes = materialize(_once(listed.select(
        "node", "n", "tokens", "parts", F.col("head.copies").alias("copies")), "node"), "prefixes")

    posted = nodes.select("node", "n", F.posexplode("tokens").alias("at", "token"))
    common = posted.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("top"))
    postings = materialize(
        posted.join(common.where("hub <> top").select("token", "hub"), "token"), "postings")
    needed = postings.select("node").distinct().join(classes.select("node", "head.*"), "node")
    texts = materialize(_once(
        docs.alias("d").join(needed.alias("c"), _same_row("d", "c"))
        .select("node", "text", "copies"), "node"), "texts")

    join = _Join(nodes, texts, width, num, den)
    met = materialize(postings.where("node <> hub").select(
        F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = join.linked(met)
    comps = components(links, "a", "b")
    mixed = _mixed(postings.drop("hub"), comps)
    for turn in range(TURNS):
        fresh = materialize(_hub_pairs(mixed, turn).join(met, ["a", "b"], "left_anti"), "stars")
        met = met.unionByName(fresh)
        new = join.linked(fresh)
        links = links.unionByName(new)
        comps = components(links, "a", "b")
        mixed = _mixed(mixed.drop("comp"), comps)
        if new.count() * WORTH < fresh.count():
            break
    links = links.unionByName(join.linked(
        _crossing(mixed, join.meta, num, den).join(met, ["a", "b"], "left_anti")))

    comps = components(links, "a", "b")
    member = classes.join(comps, "node", "left").withColumn(
        "comp", F.coalesce("component", "node"))
    least = member.groupBy("comp").agg(F.min("head").alias("least"))
    named = member.join(least, "comp").select(*key, F.col("least").alias("head"))
    full = rows.where("n > 0").join(named, key).select(*ROW, "n", "head")
    alone = rows.where("n = 0").withColumn("copies", F.lit(1).cast("long"))
    return full.unionByName(alone.select(*ROW, "n", row.alias("head")))

def similar_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Classes of documents whose sets of word n-grams are similar, exactly.

    A set is the distinct ``width``-word shingles of a text (words are runs of
    characters other than ASCII spaces, A-Z lower-cased); a shorter text is one
    shingle. Two documents link if the Jaccard similarity is ``num / den`` or more.

    1. Every set gets a 128-bit signature; equal sets are one node from here on. The
       same pass counts all shingles into a fixed number of counters.
    2. Every node lists the rarest tokens of its set, as many as similar sets cannot
       miss one another in; rarity is the counter's, ties go by hash.
    3. Tokens of more than one node pair each node with the token's first node: no
       more pairs than postings. Pairs pass the length and suffix filters and are
       verified on the whole texts.
    4. Where a token's nodes are in different components still, some turns with other
       hubs join most of them. What is left apart and shares a token is paired in
       full, under the length, positional and suffix filters, and verified once per pair.

    Only links inside a component that is known already are left out, so the classes
    are exact. ``docs`` needs ``doc_id, text``; other columns are ignored. Returns a
    row per row: ``doc_id, n_shingles, component_id`` (the smallest ``doc_id``
    reachable, itself included). Null texts and texts without words have an empty
    set and link with nothing; null identifiers are passed over unless a class has
    no other; rows that repeat an identifier stay; no rows give no rows.
    """
    return _grouped(docs, width, num, den).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are the first of their group, exactly one for each.

    Groups are those of ``similar_documents``. First is the smallest ``doc_id`` (null
    last), then the smallest hash of the text; of rows that repeat both any one stays.
    Rows without words are groups of their own and stay.
    """
    found = _grouped(docs, width, num, den)
    alone = found.where("n = 0").select(*ROW, F.lit(1).cast("long").alias("copies")).distinct()
    heads = materialize(found.where("n > 0").select(
        *[f"head.{c}" for c in ROW], "head.copies").distinct().unionByName(alone), "heads")
    key = "_key"
    while key in docs.columns:
        key += "_"
    every = docs.withColumn(key, F.struct(
        "doc_id", F.xxhash64("text").alias("th"),
        F.xxhash64(F.lit(7), "text", F.lit(7)).alias("th2")))
    kept = every.alias("d").join(heads.alias("h"), _same_row(f"d.{key}", "h"))
    once = kept.where("h.copies = 1").select("d.*")
    again = kept.where("h.copies > 1").select("d.*").dropDuplicates([key])
    return once.unionByName(again).drop(key)
