"""Source mixing, near-copy classes, and the pipeline."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest

import __spark_entry__ as entry_module
from floodgrid import runtime
from floodgrid.functions import skew
from floodgrid.llm import jaccard_join, mixing

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


# Mixing


def plain_targets(sizes, cycle=(1, 2, 3), most=3):
    """Reshares the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(most * sizes[s] for s in fixed)
        for s in free:
            target[s] = rest * weight[s] / sum(weight[f] for f in free)
        above = [s for s in free if target[s] > most * sizes[s]]
        for s in above:
            target[s] = most * sizes[s]
        fixed |= set(above)
        if not above:
            return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    names = ["s10", "s2", "é", "", None, "z"]
    weights = [rng.choice([1, 3, 200]) for _ in names]
    rows = [(i, " ".join("w" * rng.randint(0, 60)), rng.choices(names, weights)[0]) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    out = mixing.mix(table).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(_WORD.findall(t))
    want = plain_targets(sizes)
    taken, longest = collections.Counter(), collections.Counter()
    for r in out:
        assert r.size == len(_WORD.findall(r.row.text)) and r.source_size == sizes[r.row.source]
        assert abs(r.target - want[r.row.source]) < 1e-6 and r.taken == r.takes * r.size and 0 <= r.takes <= 3
        taken[r.row.source] += r.taken
        longest[r.row.source] = max(longest[r.row.source], r.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    again = {r.row.doc_id: r.taken for r in mixing.mix(table.repartition(3)).collect()}
    assert again == {r.row.doc_id: r.taken for r in out}


def test_mixing_refines_beyond_one_level(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL_BITS", 3)
    rows = [(i, "a b c", "x" if i % 5 else "y") for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for s in "xy":
        mine = [r for r in out if r.row.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3


def test_mixing_joins_with_salt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    rows = [(i, "a b c", "xyz"[i % 3]) for i in range(90)]
    assert mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).count() == 90


def test_mixing_on_odd_and_empty_tables(spark, odd):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert {r.takes for r in out if r.row.doc_id == 6} in ({0}, {1}, {2}, {3})
    nothing = mixing.mix(odd.where("text IS NULL")).collect()
    assert {(r.target, r.taken) for r in nothing} == {(0.0, 0)}


# Near copies


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = _WORD.findall((t or "").translate(_LOWER))
        out[i] = frozenset(tuple(w[p : p + 4]) for p in range(max(1, len(w) - 3))) if w else frozenset()
    return out


def plain_classes(sets, t=85):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if 100 * common >= t * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def classes_of(table, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_classes(table, **kw).collect()}


def test_classes_match_all_pairs(spark, prose, prose_table):
    sets = plain_sets([(i, t) for i, t, _ in prose])
    want = plain_classes(sets)
    assert classes_of(prose_table) == {i: (len(sets[i]), want[i]) for i in sets}


def test_classes_of_chains_and_short_texts(spark):
    """Texts that drift word by word, so that classes are wider than links; many have one to six words."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(50)]
    rows, base = [], rng.choices(words, k=60)
    for i in range(70):
        rows.append((1000 - i, " ".join(base)))
        base = list(base)
        base[rng.randrange(60)] = rng.choice(words)
    rows += [(2000 + i, " ".join(rng.choices("ab", k=rng.randint(0, 6)))) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    sets = plain_sets(rows)
    want = plain_classes(sets)
    assert classes_of(table) == {i: (len(sets[i]), want[i]) for i in sets}


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    """Unlinked texts with much in common, so that index lists are longer than a block."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(common + rng.choices([f"r{k}" for k in range(9)], k=rng.randint(0, 3)))) for i in range(150)]
    sets = plain_sets(rows)
    want = plain_classes(sets)
    nodes = {}
    for i, s in sets.items():
        nodes.setdefault(s, i)
    lists = []
    for s, i in nodes.items():
        h = np.sort(np.unique(jaccard_join.shingle_set(rows[i][1].encode())))
        p = jaccard_join.prefix_length(len(h), 85)
        # Levels high enough that every list is counted and cut.
        lists.append((i, i, len(h), [int(x) for x in ((h[:p] >> np.uint64(6)) | np.uint64(12 << 58)).view(np.int64)]))
    frame = spark.createDataFrame(lists, "node bigint, label bigint, n int, prefix array<bigint>")
    small = {tuple(r) for r in jaccard_join._candidates(frame, 85, block=7).collect()}
    large = {tuple(r) for r in jaccard_join._candidates(frame, 85).collect()}
    assert small == large
    links = {(a, b) for s, a in nodes.items() for r, b in nodes.items() if a < b and 100 * len(s & r) >= 85 * len(s | r)}
    assert links and links <= small
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert classes_of(table) == {i: (len(sets[i]), want[i]) for i in sets}


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m, common in ((5, 5, 3), (300, 280, 270), (90, 100, 80), (1000, 1010, 0), (1, 1, 1), (64, 70, 64)):
        both = rng.integers(0, 2**63, n + m - common).astype(np.uint64)
        a, b = np.sort(both[:n]), np.sort(both[n - common :])
        least = jaccard_join.least_difference(jaccard_join.parity_bits(a), jaccard_join.parity_bits(b))
        assert least <= n + m - 2 * common and (least == 0) == (n + m == 2 * common)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 250)]
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 250: 200, 300: 200}


def test_classes_on_odd_and_empty_tables(spark, odd):
    got = [tuple(r) for r in jaccard_join.link_classes(odd).collect()]
    assert len(got) == odd.count()
    assert got.count((6, 1, 6)) == 2 and (1, 0, 1) in got and (None, 0, None) in got and (None, 3, None) in got
    assert jaccard_join.link_classes(odd.limit(0)).count() == 0
    kept = jaccard_join.one_of_each_class(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert jaccard_join.one_of_each_class(odd.limit(0)).count() == 0


def test_classes_of_one_id_on_different_texts(spark):
    """Ids 5 and 7 name two texts each; one text of 5 links with 6, the other with 4, and no text of 7 with the other."""
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(5, texts[0]), (5, texts[1]), (6, texts[0] + " end"), (4, texts[1] + " end"), (7, texts[2]), (7, texts[3]), (9, texts[3] + " end"), (8, texts[2] + " end")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_classes(table).collect())
    assert got == [(4, 58, 4), (5, 57, 4), (5, 57, 5), (6, 58, 5), (7, 57, 7), (7, 57, 7), (8, 58, 7), (9, 58, 7)]
    # An id of two texts, only one of which links: the other stays a class of its own.
    rows = [(3, texts[0] + " end"), (5, texts[0]), (5, texts[1])]
    got = sorted(tuple(r) for r in jaccard_join.link_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(3, 58, 3), (5, 57, 3), (5, 57, 5)]


def test_one_row_of_each_class_stays(spark, prose, prose_table):
    want = plain_classes(plain_sets([(i, t) for i, t, _ in prose]))
    kept = jaccard_join.one_of_each_class(prose_table).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    # Numbered rows: ids repeat, or are missing.
    twice = prose_table.unionByName(prose_table.where("doc_id < 5"))
    assert sorted(r.doc_id for r in jaccard_join.one_of_each_class(twice).collect()) == sorted(set(want.values()))


def test_join_with_hot_keys(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END AS k")
    values = spark.range(500).selectExpr("id AS k", "id * 10 AS v")
    for how in ("inner", "left"):
        got = {tuple(r) for r in skew.join_hot(rows, values, "k", how=how).select("id", "v").collect()}
        assert got == {tuple(r) for r in rows.join(values, "k", how).select("id", "v").collect()}


# Pipeline


def test_pipeline_matches_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {r.doc_id: r.asDict() for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_shards"]
    from floodgrid.runtime import materialize

    tables = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
        tables.append(docs)
    good, single, clean, mixed, tokens = tables
    for t in (good, single, clean, mixed):
        assert t.columns == list(next(iter(seen.values())))
        assert all(seen[r.doc_id] == r.asDict() for r in t.collect())
    texts = [(r.doc_id, r.text) for r in good.collect()]
    want = plain_classes(plain_sets(texts))
    assert sorted(r.doc_id for r in single.collect()) == sorted({want[i] for i, _ in texts})
    takes = collections.Counter(r.doc_id for r in mixed.collect())
    want = {r.row.doc_id: r.takes for r in mixing.mix(clean).collect() if r.takes}
    assert takes == want
    assert collections.Counter(r.doc_id for r in tokens.collect()) == takes
    whole = entry_module.queries()["pipeline"](spark, sf).collect()
    digest = lambda rows: hashlib.md5(repr(sorted(tuple(r) for r in rows)).encode()).hexdigest()
    assert digest(whole) == digest(tokens.collect())


def test_near_copy_rule_is_passed_by_the_stage(monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard_join, "one_of_each_class", lambda docs, **rule: seen.append(rule))
    corpus_pipeline.drop_near_copies(None, None, "")
    assert seen == [{"k": 4, "t": 85}]


def test_long_benchmark_passages_are_cut_from_kept_documents(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(100))
    filler = " ".join(f"w{i}" for i in range(2500))
    spark.createDataFrame([("x", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    short = " ".join(item.split()[:20])
    texts = [f"{filler} {item} {filler}", f"{item} end", f"{filler} {short} {filler}", filler, None]
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: tuple(r) for r in out.collect()}
    cut = f"{filler}  {filler}"
    assert got == {0: (0, cut, "en", "s", len(cut)), **{i: rows[i] for i in (2, 3, 4)}}


def test_pipeline_of_an_empty_table(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def clashing(spark, rows):
    """(doc_id, text, source) rows with columns named like those that operators use themselves."""
    extra = "_cell int, _dropped string, id int, row string, cell int, a int, b int, node int, label int, bits int, more boolean, takes int"
    return spark.createDataFrame([(*r, 1, "x", 2, "r", 3, 4, 5, 6, 7, 8, True, 9) for r in rows], f"doc_id bigint, text string, source string, {extra}")


def test_classes_beside_clashing_columns(spark, prose):
    rows = [(i, t, s) for i, t, s in prose]
    df = clashing(spark, rows).repartition(4)
    want = plain_classes(plain_sets([(i, t) for i, t, _ in rows]))
    kept = jaccard_join.one_of_each_class(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    twice = jaccard_join.one_of_each_class(df.unionByName(df))
    assert twice.columns == df.columns and sorted(r.doc_id for r in twice.collect()) == sorted(set(want.values()))


def test_pipeline_of_odd_rows(spark):
    """Nulls, repeated rows, a very long text and clashing columns go through all stages."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [". ".join(" ".join(rng.choices(words, k=12)) for _ in range(n)) for n in (30, 40, 50, 1200)]
    rows = [(1, texts[0], "a"), (1, texts[0], "a"), (None, texts[1], None), (None, None, "a"), (2, None, None), (3, "", "b"), (4, texts[2], "é"), (5, texts[3], "b"), (6, texts[0], "c")]
    docs = clashing(spark, rows)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == names, name
    assert {r.text for r in docs.collect()} <= {*texts, None, ""}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == docs.count()


def test_pairs_that_leave_the_lists_grow_with_sets(spark, monkeypatch):
    """A group of copies with words of their own: few of its pairs are compared on whole sets."""
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
    rows = []
    for i in range(250):
        mine = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            mine[rng.randrange(200)] = f"u{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(mine)))
    left = []
    verified = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *args: left.append(pairs.count()) or verified(pairs, *args))
    sets = plain_sets(rows)
    want = plain_classes(sets)
    assert classes_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == {i: (len(sets[i]), want[i]) for i in sets}
    links = sum(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for i in sets for j in range(i))
    assert links > 20 * len(rows) and sum(left) < 12 * len(rows), (left, links)


def test_best_pairs_of_rows():
    i, j, worth = (np.array(v) for v in ((0, 0, 0, 1, 1), (1, 2, 3, 2, 3), (5, 9, 7, 2, 1)))
    # As the first of a pair row 0 has its best in (0, 2) and row 1 in (1, 2), as the second row 3 in (0, 3).
    assert jaccard_join.best_of_rows(i, j, worth, 1).tolist() == [True, True, True, True, False]
    assert jaccard_join.best_of_rows(i, j, worth, 2).tolist() == [True] * 5
    found = jaccard_join.PairRows(1)
    found.add(i, j, worth)
    out = found.batch(np.array([40, 30, 20, 10]))
    assert out.to_pydict() == {"a": [10, 20, 20, 30], "b": [40, 30, 40, 40], "more": [True] * 4}


def test_pipeline_passes_small_batches_and_frees_what_stages_leave(spark):
    from floodgrid.llm import decontaminate, texts

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, "a b c d") for i in range(3)], "doc_id long, text string").coalesce(1)
    try:
        spark.conf.set(key, 0)
        corpus_pipeline.keep_good(spark, docs.selectExpr("doc_id", "text", "'x' as source"), "")
        assert spark.conf.get(key) == "1000"
        spark.conf.set(key, 10)
        corpus_pipeline.keep_good(spark, docs.selectExpr("doc_id", "text", "'x' as source"), "")
        assert spark.conf.get(key) == "10"
    finally:
        spark.conf.set(key, before)
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    found = decontaminate.benchmark_hits(docs, items)

    def left(batches):
        import pyarrow as pa

        texts._KEPT.append({"old": 1})
        kept = texts._KEPT[-1]
        texts.clear_others()
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(kept)]}, schema=pa.schema([("n", pa.int64())]))

    assert {r["n"] for r in found.select("t").mapInArrow(left, "n long").collect()} == {0}


def test_near_copies_leave_only_their_classes_on_disk(spark, prose_table, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: f"file://{tmp_path}/{spark.sparkContext.applicationId}")
    kept = jaccard_join.one_of_each_class(prose_table)
    # What the rows that stay are read from: the classes.
    tables = {str(p.parent) for p in tmp_path.rglob("*.parquet")}
    assert len(tables) == 1
    assert spark.read.parquet(*tables).columns == ["doc_id", "n_shingles", "component_id"]
    assert kept.count() == spark.read.parquet(*tables).where("doc_id = component_id").count()
