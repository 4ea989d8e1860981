"""Operators against brute force, SQL and edge cases."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import (
    chat, components, covertree, decontaminate, jaccard, langid, licenses, linededup, mixing,
    passages, pii, queries,
)
from tests.oracle import compare, connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, _row int"


def docs(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, src, None, "clash", 1) for i, t, lang, src in rows], DOCS)


EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t", "en", "a"), (4, "one", "en", None),
    (5, "same text here " * 20, "en", "a"), (6, "same text here " * 20, "en", "b"),
    (6, "same text here " * 20, "en", "b"), (None, "no identifier", "en", "b"),
    (7, "long " * 30000, None, "a"), (8, "12345 !!!", "en", "c"), (9, "É ñ ü ß", "fr", "c")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.SQL[name]) is None


# --- personal data -------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in
                                                           m.group().split(".")),
                  "card": lambda: 14 <= len(d) <= 19 and luhn(d),
                  "phone": lambda: 10 <= len(d) <= 15}[k]()
            if ok:
                out.append((k, m.start(), m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", [
    "a@b.c", "@a.b a@@b.c x@y", "a.b+c@d-e.f.g@h.i", "1.2.3.4.5 256.1.1.1 0001.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (988) 555-2485 +12 +49(30)1234567890",
    "é@x.de ñ 7.7.7.7", "+1.2.3.4.5.6.7.8.9.0", "a" * 5000 + "@" + "b" * 5000 + ".c"])
def test_base_spans(text):
    assert sorted(pii.base_spans(text)[0]) == plain_spans(text)


def test_personal_data(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op1_personal_data"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = plain_spans(r.text or "")
        assert got[r.doc_id].base_sha256 == pii.digest(base)
        listed = set(got[r.doc_id].spans.split(","))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= listed


def test_personal_data_edges(spark):
    found = pii.find_personal_data(docs(spark, EDGE), keep=["doc_id", "_row"])
    assert found.count() == len(EDGE)
    assert pii.find_personal_data(docs(spark, EDGE).limit(0)).count() == 0
    assert pii.masked("to a@b.c!", [{"kind": "email", "start": 3, "end": 8}]) == "to [EMAIL]!"
    # a labeler that agrees with the others is trusted more than one that does not
    p = pii.estimate([("ip", "+++++", 50), ("ip", "-----", 50), ("ip", "+0+++", 5)])
    assert p["ip", "+++++"] > 0.9 > 0.1 > p["ip", "-----"]


def test_equal_spans_are_one_row_of_the_sample(spark, monkeypatch):
    """A span in very many documents neither floods the driver nor leaves nothing to learn from."""
    texts = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("write to ip 10.1.2.3 at once "), F.when(
            F.col("id") % 1000 == 0, F.concat(F.lit("card 4111 1111 1111 1111 number "), "id"))
        .otherwise(F.lit(""))).alias("text"))
    taken = []
    plain = pii.train
    monkeypatch.setattr(pii, "train", lambda f, t, n: taken.append((len(f), sum(n))) or plain(f, t, n))
    found = pii.find_personal_data(texts, training_spans=50)
    assert found.where(F.size("spans") < 1).count() == 0
    (rows, spans), = taken
    assert 1 <= rows <= 50 and spans >= 60_000


# --- language ------------------------------------------------------------------------

def test_language(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.QUERIES["op3_language"](spark, sf).join(table.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] >= 0.9
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_keeps_columns(spark):
    rows = docs(spark, EDGE).withColumnRenamed("hits", "_found").withColumnRenamed("_row", "a.b")
    got = langid.identify(rows, langid.fit(rows))
    assert got.columns == [*rows.columns, "lang_pred", "score", "known_share"]
    assert {r["_found"] for r in got.collect()} == {"clash"}


def test_language_edges(spark):
    model = langid.fit(docs(spark, [(i, "the cat and the dog " * 3, "en", "a") for i in range(9)]
                            + [(i, "der hund und die katze " * 3, "de", "a") for i in range(9)]))
    got = langid.identify(docs(spark, EDGE), model).collect()
    assert len(got) == len(EDGE)
    assert {r.lang_pred for r in got if not re.search(r"[^\W\d_]", r.text or "")} == {"und"}
    none = langid.fit(docs(spark, EDGE).limit(0))
    assert {r.lang_pred for r in langid.identify(docs(spark, EDGE), none).collect()} == {"und"}
    # every language that holds an n-gram is returned
    hashes, _, _ = langid.grams(["the"])
    assert all(int(m) >> model.languages.index("en") & 1 for m in model.masks(hashes))


# --- benchmarks, mixing, chat --------------------------------------------------------

def test_decontaminate(spark, monkeypatch):
    items = spark.createDataFrame(
        [(1, "One two three four five six seven eight nine ten eleven"), (2, "Ünder-cut"),
         (None, "x1"), (3, None), (1, "x1")], "item_id long, text string")
    rows = docs(spark, [
        (1, "é: two THREE four five-six seven eight nine ten, eleven", "", ""),
        (2, "one two three four five six seven eight nine", "", ""), (3, "ünder? CUT x1", "", ""),
        *EDGE])
    once = {(r.doc_id, r.text): r.hits for r in decontaminate.decontaminate(rows.drop("hits"), items)
            .collect()}
    first = once[1, "é: two THREE four five-six seven eight nine ten, eleven"]
    assert [tuple(r) for r in first.runs] == [(1, 11)] and first.items == ["1"]
    assert "é: two THREE four five-six seven eight nine ten, eleven"[slice(*first.spans[0])] \
        .startswith("two")
    assert once[2, "one two three four five six seven eight nine"].items == []
    assert once[3, "ünder? CUT x1"].items == ["", "1"]  # "Ü" is no a-z letter and stays as it is
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", 40)  # several automata
    again = {(r.doc_id, r.text): r.hits for r in decontaminate.decontaminate(
        rows.drop("hits"), items).collect()}
    assert again == once
    assert decontaminate.decontaminate(rows.drop("hits"), items.limit(0)).where(
        F.size("hits.runs") > 0).count() == 0


def test_mixing_edges(spark):
    got = mixing.mix_sources(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(docs(spark, EDGE).limit(0)).count() == 0
    assert sum(r.taken for r in mixing.mix_sources(docs(spark, EDGE[:1])).collect()) == 0


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), (None, 490)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 1, 2, 3; a stops at 30, the other 970 are shared 2 to 3
    assert got == {"a": 30.0, "b": 388.0, None: 582.0}


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind"), (1, 1, "Ann B", "hi"), (1, 2, "bob", None), (1, 2, None, "x"),
         (2, 0, "system", "alone"), (None, 0, "bob", "y")],
        "conv_id long, turn int, role string, text string")
    got = chat.rotate(turns)
    assert got.count() == 3 * 4 + 1
    ann = got.where("perspective = 'Ann B'").orderBy("turn", "segment").collect()
    assert [r.chat_role for r in ann] == ["system", "assistant", "user", "user"]
    assert {r.name for r in ann} == {None, "bob", "unknown"}
    assert ann[1].segment[ann[1].mask_start:ann[1].mask_end] == "hi<|im_end|>"
    whole = chat.dialogues(got).where("perspective = 'Ann B'").collect()
    assert whole[0].text == "".join(r.segment for r in ann)
    assert [whole[0].text[a:b] for a, b in whole[0].masks] == ["hi<|im_end|>"]
    assert chat.dialogues(chat.rotate(turns.limit(0))).count() == 0


def test_dialogues(spark, monkeypatch):
    """Equal and missing turn numbers, names that clash, parts of few turns, spans of few parts."""
    monkeypatch.setattr(chat, "SPAN", 2)
    turns = spark.createDataFrame(
        [(c, None if i % 3 == 0 else 7, ["a", "b", "system"][i % 5 % 3], f"text {i % 20}" * (i % 4))
         for c in (1, None) for i in range(60)], "conv_id long, turn int, role string, text string"
    ).withColumn("position", F.lit("x")).withColumn("_task", F.lit(2)).withColumn("part", F.lit(3))
    rotated = chat.rotate(turns)
    parts = chat.dialogues(rotated, 7).orderBy("part").collect()
    for conv in (1, None):
        rows = sorted((r for r in turns.collect() if r.conv_id == conv),
                      key=lambda r: (r.turn is not None, r.turn, r.role, r.text))
        for who in ("a", "b"):
            text, own = "", []
            for r in rows:
                role = ("system" if r.role == "system" else
                        "assistant" if r.role == who else f"user name={r.role}")
                text += f"<|im_start|>{role}\n{r.text}<|im_end|>\n"
                own += [f"{r.text}<|im_end|>"] if r.role == who else []
            mine = [p for p in parts if p.conv_id == conv and p.perspective == who]
            assert "".join(p.text for p in mine) == text
            assert [p.n_turns for p in mine] == [7] * 8 + [4]
            assert all(text[p.offset:].startswith(p.text) for p in mine)
            assert [text[a:b] for p in mine for a, b in p.masks] == own


# --- copies --------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def groups(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_jaccard(spark, sf, width, num):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in table.collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[j:j + width]) for j in range(max(1, len(w) - width + 1))} \
            if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b])
             >= num * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in groups(ids, links).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.similar_documents(table, width, num, 100).collect()}
    assert got == want


def test_jaccard_edges(spark):
    got = jaccard.similar_documents(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert {r.n_shingles for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert jaccard.similar_documents(docs(spark, EDGE).limit(0)).count() == 0


def test_jaccard_without_identifiers(spark):
    """Rows that share an identifier, or have none, are told apart by their text."""
    def text(k, edit=0):
        return " ".join(f"w{k}x{i}" for i in range(100)) + " end" * edit
    plain = [(None, text(0)), (None, text(1)), (None, text(0, 1)), (1, text(2)),
             (None, text(2, 1)), (None, text(3)), (None, text(3)), (7, text(4)), (7, text(5)),
             (8, text(5, 1)), (9, text(6)), (9, text(6)), (None, None), (None, ""),
             # shares a rare shingle with texts 0 and 1, but is near to neither
             (None, "w0x0 w0x1 w0x2 w0x3 w0x4 w1x0 w1x1 w1x2 w1x3 w1x4 " + text(8))]
    rows = docs(spark, [(i, t, "", str(k)) for k, (i, t) in enumerate(plain)])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0)
                 for r in jaccard.similar_documents(rows).collect())
    sizes = {k: max(0, len(words(t)) - 4) for k, (_, t) in enumerate(plain)}
    low = {3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 10: 9, 11: 9}
    assert got == sorted((i or 0, sizes[k], low.get(k, 0)) for k, (i, _) in enumerate(plain))
    kept = jaccard.one_per_group(rows)
    assert kept.columns == rows.columns
    sources = [int(r.source) for r in kept.collect()]
    of = {0: 0, 2: 0, 5: 5, 6: 5, 8: 8, 9: 8, 10: 10, 11: 10, 3: 3, 4: 3}
    assert sorted(of.get(k, k) for k in sources) == [0, 1, 3, 5, 7, 8, 10, 12, 13, 14]
    assert {3, 8} <= set(sources)


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(40, 50), (50, 60), (7, 7), (None, 3)]
    got = components.components(spark.createDataFrame(chain, "x long, y long"), "x", "y")
    assert {r.node: r.component for r in got.collect()} == {
        **{i: 0 for i in range(21)}, 40: 40, 50: 40, 60: 40}


def test_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(
        f"{sf}/embeddings.parquet").collect()]
    rows += [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, rows[0][1]),
             (9005, [2 * v for v in rows[0][1]]), (9006, [1.0, 2.0]), (9007, [1.0, 2.1]),
             (9008, []), (9009, [float("inf")] + [1.0] * 63)]
    good = {i: np.array(v, float) for i, v in rows if v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b])
             and unit[a] @ unit[b] >= 0.9]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    group = groups([i for i, _ in rows], links)
    want = {i: (n[i], group[i], group[i] == i) for i, _ in rows}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in covertree.similar_vectors(table).collect()}
    assert got == want
    assert covertree.similar_vectors(table.limit(0)).count() == 0


def test_cover_tree():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    points = np.concatenate([base[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.05, base])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = covertree.Tree(points)
    for c, r, a, b in zip(tree.centre, tree.radius, tree.begin, tree.end):
        below = points[tree.order[a:b]]
        assert np.sqrt(((below - points[c]) ** 2).sum(1)).max() <= r + 1e-12
    w = np.ones(len(points), np.int64)
    n_x, n_y, _ = covertree.dual(tree, tree, w, w, 0.9)
    assert ((n_x + n_y) == (points @ points.T >= 0.9).sum(1) - 1).all()


@pytest.mark.parametrize("noise, dim, least", [
    (0.33, 64, 0.9), (0.02, 64, 0.9), (1.0, 3, 0.9), (0.0, 8, 0.9), (1e-9, 8, 0.9), (1e-9, 4, 1.0)])
def test_dual_traversal(noise, dim, least):
    """Hot directions, loose and tight; few dimensions; copies and what rounding makes alike."""
    rng = np.random.default_rng(2)
    hot = rng.normal(size=dim)
    sides = [hot + noise * rng.normal(size=(n, dim)) for n in (700, 400)]
    sides = [np.concatenate((s, rng.normal(size=(90, dim)))) for s in sides]
    x, y = (s / np.linalg.norm(s, axis=1, keepdims=True) for s in sides)
    w_x, w_y = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    tree, other = covertree.Tree(x), covertree.Tree(y)
    if least < 1:
        near = (x[:, None, :] * y[None, :, :]).sum(2) >= least
        counts = {}
        n_x, n_y, edges = covertree.dual(tree, other, w_x, w_y, least, counts)
        assert (n_x == near @ w_y).all() and (n_y == near.T @ w_x).all()
        assert sum(counts.values()) == len(x) * len(y)
        assert all(near[i, j] for i, j in edges)
    counts = {}
    n_x, n_y, edges = covertree.dual(tree, tree, w_x, w_x, least, counts)
    assert sum(counts.values()) == len(x) * (len(x) - 1) // 2
    if least < 1:
        near = (x[:, None, :] * x[None, :, :]).sum(2) >= least
        np.fill_diagonal(near, False)
        assert (n_x + n_y == near @ w_x).all()
        a, b = np.nonzero(near)
        group = groups(range(len(x)), list(zip(a.tolist(), b.tolist())))
        assert groups(range(len(x)), edges) == group


def test_bounds_prune(spark, sf):
    """Among random directions nearly all pairs fall to bounds, within and between trees."""
    points = np.array([r.embedding for r in spark.read.parquet(
        f"{sf}/embeddings.parquet").collect()], float)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    half = len(points) // 2
    trees, counts = [covertree.Tree(p) for p in (points[:half], points[half:])], {}
    w = np.ones(len(points), np.int64)
    covertree.dual(*trees, w[:half], w[half:], 0.9, counts)
    for tree in trees:
        covertree.dual(tree, tree, w[:len(tree.points)], w[:len(tree.points)], 0.9, counts)
    assert sum(counts.values()) == len(points) * (len(points) - 1) // 2
    assert counts["pruned"] > 0.9 * sum(counts.values())


def test_passages(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    where = defaultdict(set)
    for r in table.collect():
        w = words(r.text)
        for j in range(len(w) - 49):
            where[tuple(w[j:j + 50])].add(r.doc_id)
    want = [s for s in where.values() if len(s) > 1]
    got = passages.repeated_passages(table).collect()
    ids = {r.doc_id for r in table.collect()}
    group = groups(ids, [(r.doc_id, r.match_doc_id) for r in got])
    assert all(len({group[i] for i in s}) == 1 for s in want)
    assert all(r.end_word - r.start_word >= 50 for r in got)


def test_passages_edges(spark):
    got = passages.repeated_passages(docs(spark, EDGE)).collect()
    assert {(r.doc_id, r.match_doc_id, r.end_word) for r in got} == {(6, 5, 60)} and len(got) == 2
    assert passages.repeated_passages(docs(spark, EDGE).limit(0)).count() == 0


@pytest.mark.parametrize("at", [0, 25, 45])
def test_passage_with_earlier_phrase(at):
    """A near copy holds a phrase that the other text also has before it, alone or often."""
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    phrase, body = new(24), new(45)
    copy = np.concatenate((body[:at], phrase, body[at:]))
    edited = copy.copy()
    edited[34:37] = new(3)
    for times in (1, 7):
        y = np.concatenate([new(40), *[np.concatenate((phrase, new(30))) for _ in range(times)],
                            copy, new(20)])
        x = np.concatenate((new(9), edited, new(9)))
        start = 40 + 54 * times
        assert passages.matches(x, y, 46, 80, 100) == [(9, 77, start, start + 68)]
    # the passage twice in the other text is one match
    assert len(passages.matches(x, np.concatenate((copy, new(30), copy)), 46, 80, 100)) == 1


def test_frequent_shingles_meet_all_their_places():
    """A near copy far into a text, all of whose shingles stand there some forty times."""
    rng = np.random.default_rng(31)

    def blocks():
        draws = np.concatenate([rng.permutation(200) for _ in range(40)]).reshape(80, 100)
        apart = rng.integers(1 << 20, 1 << 62, (80, 20))
        return np.hstack((draws, apart)).astype(np.uint64).ravel()

    x, y = blocks(), blocks()
    x[3600:3700] = y[7200:7300]
    x[[3630, 3660]] = 1 << 21, 1 << 22
    assert passages.matches(x, y, 46, 80, 100) == [(3600, 3699, 7200, 7299)]


def test_stretches_of_many_places(monkeypatch):
    """Equal shingles side by side, however many are looked at together."""
    rng = np.random.default_rng(32)
    for met in (1, 7, 1 << 18):
        monkeypatch.setattr(passages, "MET", met)
        x, y = (rng.integers(0, 3, n).astype(np.uint64) for n in (40, 55))
        equal = {(i, j) for i in range(40) for j in range(55) if x[i] == y[j]}
        found = passages._stretches(x, y, np.argsort(y, kind="stable")).T.tolist()
        assert found == sorted(found)
        ways = [[(x0 + k, y0 + k) for k in range(x1 - x0 + 1)] for x0, x1, y0, _ in found]
        assert sorted(p for w in ways for p in w) == sorted(equal)
        assert all((w[0][0] - 1, w[0][1] - 1) not in equal for w in ways)
        assert all(y1 - y0 == x1 - x0 for x0, x1, y0, y1 in found)


def _linked(spark, texts):
    rows = passages.repeated_passages(
        docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    return groups(range(len(texts)), [(r.doc_id, r.match_doc_id) for r in rows])


def test_every_similar_passage_is_found(spark):
    """Passages at the threshold, in texts that share nothing else, or one phrase of 30 words."""
    rng = np.random.default_rng(11)
    new = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    hot, pairs = new(30), []
    for _ in range(40):
        a = new(50)
        pairs.append((a, a[:24] + new(1) + a[25:]))  # 41 of 51 shingles
        a = new(94)
        pairs.append((a, a[:31] + new(1) + a[32:63] + new(1) + a[64:]))
        a = new(52)
        pairs.append((a, a[:19] + a[14:36] + a[31:]))  # two phrases said twice
        a = hot + new(20)
        pairs.append((a, a[:35] + new(1) + a[36:]))
        a = new(10) + hot + new(12)
        pairs.append((a, a[:42] + new(1) + a[43:]))
    texts = [" ".join(new(20) + t + new(20)) for pair in pairs for t in pair]
    group = _linked(spark, texts)
    assert [i for i in range(len(pairs)) if group[2 * i] != group[2 * i + 1]] == []
    assert len(set(group.values())) == len(pairs)


def test_near_copies_of_near_copies(spark):
    """Of three texts the middle one is similar to both others, which are not to each other."""
    rng = np.random.default_rng(12)
    new = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    texts = []
    for _ in range(12):
        a = new(52)
        b = a[:14] + new(1) + a[15:]
        c = b[:38] + new(1) + b[39:]
        assert passages.matches(*[np.array([hash(tuple(t[i:i + 5])) for i in range(48)]).astype(
            np.uint64) for t in (a, c)], 46, 80, 100) == []
        texts += [" ".join(new(9) + t + new(9)) for t in (a, b, c)]
    group = _linked(spark, texts)
    assert all(len({group[3 * i + k] for k in range(3)}) == 1 for i in range(12))


def test_least_run():
    assert passages.least_run(46, 80, 100) == 12 and passages.least_common(46, 80, 100) == 41
    assert passages.least_run(46, 100, 100) == 46 and passages.least_run(1, 80, 100) == 1


def test_texts_of_a_hub_are_matched_at_once(monkeypatch):
    """Near copies of one hub need no step each; others, and all results, are as one by one."""
    rng = np.random.default_rng(21)
    new = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    hub, texts = new(400), []
    for k in range(40):
        copy = hub.copy()
        for at in rng.integers(0, 390, k):
            copy[at:at + 5] = new(5)
        texts.append(np.concatenate((new(k), copy[k:], new(9))))
    plain = len(texts)
    texts += [np.concatenate((hub[200:300], new(60), hub[20:90], hub[90:150])), hub[:45], new(70),
              np.concatenate((hub[:60], hub[30:120])), np.repeat(hub[:20], 30), new(0)]
    calls, one = [], passages.matches
    want = [one(x, hub, 46, 80, 100) for x in texts]
    monkeypatch.setattr(passages, "matches", lambda *a: calls.append(1) or one(*a))
    assert passages.matches_of_hub(texts, hub, 46, 80, 100) == want
    assert len(calls) <= len(texts) - plain and all(want[:5]) and not want[plain + 1]
    # the passages are similar, and no equal run is left out
    for x, found in zip(texts[:plain], want):
        for x0, x1, y0, y1 in found:
            p, q = set(x[x0:x1 + 1].tolist()), set(hub[y0:y1 + 1].tolist())
            assert len(p & q) >= 0.8 * len(p | q) and x1 - x0 >= 45


def test_bound_of_repeated_words(monkeypatch):
    """No similar passage is above the bound; sets as bits and as sets agree."""
    rng = np.random.default_rng(22)
    for trial in range(60):
        runs = lambda: np.repeat(rng.integers(1, 9, 30), rng.integers(1, 7, 30)).astype(
            np.uint64)
        x, y = runs(), runs()
        if trial % 2:
            x[20:60] = y[10:50]
        held, places = np.isin(x, y), np.argsort(x, kind="stable")
        spare, base = passages._spare(x, held, places, 80, 100)
        for a, b in rng.integers(0, len(x), (200, 2)):
            if a <= b:
                p = set(x[a:b + 1].tolist())
                if len(p & set(y.tolist())) >= 0.8 * len(p):
                    assert spare[b + 1] >= base[a]
        monkeypatch.setattr(passages, "FEW", 256)
        bits = passages.matches(x, y, 20, 80, 100)
        monkeypatch.setattr(passages, "FEW", 0)
        assert passages.matches(x, y, 20, 80, 100) == bits


def test_fewest_distinct():
    x = np.random.default_rng(4).integers(0, 30, 90).astype(np.uint64)
    for n in (90, 20, 7):
        many = [len(set(x[i:min(i + 20, n)].tolist())) for i in range(max(1, n - 19))]
        want = [min(many[max(0, min(c - 19, len(many) - 1)):c + 1]) for c in range(n)]
        assert passages._fewest_distinct(x[:n], 20, np.arange(n)).tolist() == want


def test_compact_windows():
    values = np.random.default_rng(2).integers(0, 1 << 62, 400).astype(np.uint64)
    got = set(zip(*(a.tolist() for a in passages.compact_windows(values, 20))))
    want = set()
    for c in range(400):
        lo, hi = c, c
        while lo and values[lo - 1] > values[c]:
            lo -= 1
        while hi < 399 and values[hi + 1] > values[c]:
            hi += 1
        if hi - lo + 1 >= 20:
            want.add((c, lo, hi))
    assert got == want


def test_lines_edges(spark):
    got = linededup.dedup_lines(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r.text for r in got}
    assert by[5] == "same text here " * 20 and by[6] == "" and by[1] is None and by[2] == ""
    run = "\n".join(f"a line of some words {i}" for i in range(4))
    rows = docs(spark, [(1, f"{run}\nend one", "", ""), (2, f"start\n{run}\n\nend two", "", ""),
                        (3, "short\n" * 30, "", "")])
    cut = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(rows).collect()}
    assert cut[1] == (f"{run}\nend one", 0) and cut[2] == ("start\n\nend two", 4)
    assert cut[3][1] == 29  # each later line begins a run that was there before
    assert linededup.dedup_lines(rows.limit(0)).count() == 0


def test_short_lines_and_repeated_rows(spark):
    short = "a line of thirty characters xx"
    rows = [(i, f"own {i}\n{short}", "en", "a") for i in range(1, 30)]
    rows += [(None, "no\nidentifier", "en", "b")] * 3 + [(50, "two\nequal rows", "en", "b")] * 2
    table = docs(spark, rows).withColumn("n_lines", F.lit("clash")).withColumn("_th", F.lit(1.5)) \
        .withColumn("row.x", F.lit(2))
    out = linededup.dedup_lines(table)
    assert out.columns == [*[c for c in table.columns if c != "n_lines"], *linededup.COUNTS]
    got = out.collect()
    assert sorted(r.text for r in got if (r.doc_id or 99) < 30) == sorted(
        [f"own 1\n{short}"] + [f"own {i}" for i in range(2, 30)])
    assert {(r.n_removed, r.longest_run) for r in got if 1 < (r.doc_id or 0) < 30} == {(1, 1)}
    assert sorted(r.text for r in got if r.doc_id is None) == ["", "", "no\nidentifier"]
    assert sorted((r.text, r.n_removed, r.longest_run) for r in got if r.doc_id == 50) == [
        ("", 2, 2), ("two\nequal rows", 0, 0)]
    assert {(r["_th"], r["row.x"], r.hits) for r in got} == {(1.5, 2, "clash")}


def test_licenses(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    scanner = licenses.train(table)
    rows = docs(spark, [
        (1, "Some prose.\nLicensed under the Apache License, Version 2.0.", "", ""),
        (2, "Licensed under CC BY-SA 4.0.\nHe lost his driving licence.", "", ""), *EDGE])
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.scan(rows, scanner).collect()}
    assert got == {(1, 1): "Apache", (2, 0): "CC-BY-SA", (2, 1): "unknown"}
    found = licenses.scan(table, scanner).where("family <> 'unknown'")
    lines = table.select(F.explode(F.split("text", "\n")).alias("line"))
    known = {t for texts in licenses.TEMPLATES.values() for t in texts}
    assert found.count() >= lines.where(F.col("line").isin(*known)).count() > 0


def test_licenses_learn_from_all_documents(spark, monkeypatch):
    """Every different sentence without an anchor counts once, also a long one."""
    seen = {}

    def recorded(df, tag):
        seen[tag] = plain(df, tag)
        return seen[tag]

    plain = licenses.materialize
    monkeypatch.setattr(licenses, "materialize", recorded)
    long = "and on " * 400
    rows = [(i, f"The first of {i}. The second of {i}.\nMIT License.\n{long}", "", "")
            for i in range(1500)]
    scanner = licenses.train(docs(spark, [*rows, (None, None, "", ""), (1500, "", "", "")]))
    assert seen["unknown"].agg(F.sum("n")).first()[0] == 2 * 1500 + 2  # long lines, empty ones
    assert seen["unknown"].count() <= 20  # by features and half
    assert 0.5 <= scanner.threshold <= 1
    weights = {r[0]: r[1] for r in seen["examples"].groupBy("label").agg(F.sum("weight")).collect()}
    assert weights[len(licenses.TEMPLATES)] > licenses.CORPUS_WEIGHT * len(licenses._given())


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = table
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == table.columns, name
        path = f"{p.scratch_path(spark, 'test')}"
        out.write.parquet(path)
        before, kept = kept, spark.read.parquet(path)
        assert 0 < kept.count() <= before.count()
    assert kept.count() > 0.7 * table.count()
    mixed = p.STAGES[-1][1](spark, kept, sf)
    assert mixed.where("taken > 3 * size OR copies < 1").count() == 0
    assert [tuple(r) for r in p.run(spark, sf).orderBy("doc_id").collect()] \
        == [tuple(r) for r in mixed.orderBy("doc_id").collect()]
    for _, stage in p.STAGES:
        assert stage(spark, table.limit(0), sf).count() == 0


def test_digest():
    assert pii.digest([]) == hashlib.sha256(b"").hexdigest()
