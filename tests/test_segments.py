import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import search as S
from pagelake.operators import segments as SEG
from pagelake.sources import commits
from pagelake.sources.store import new_path

from test_search import WORDS, as_dict, brute, brute_top

LAYOUT = SEG.Layout(slot_docs=8, fanout=3, ranges=4)


def texts_of(rng, n):
    return {i: " ".join(["the"] * rng.randint(0, 3) + rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=rng.randint(0, 25))) for i in n}


QUERIES = {0: "sun moon", 1: "the", 2: "Rock, fire wind", 3: "nowhere sun", 4: "sea sea the sky", 5: "absent"}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def files(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, it = set(), folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    while it.hasNext():
        status = it.next()
        found.add((str(status.getPath()), status.getModificationTime()))
    return found


@pytest.fixture(scope="module")
def built(spark):
    """Four batches with replaced and deleted documents, and the documents that are left."""
    rng = random.Random(11)
    path = new_path(spark, "segments")
    state, stages = {}, []
    for name, ids, gone in (("a", range(150), []), ("b", range(40, 70), [3, 4, 9999]), ("c", range(140, 160), list(range(60, 65))), ("d", range(50, 55), [])):
        docs = texts_of(rng, ids)
        state = {k: v for k, v in state.items() if k not in gone} | docs
        before = files(spark, f"{path}/segments") if stages else set()
        assert SEG.add_batch(frame(spark, docs), "doc_id", ["text"], path, name, frame(spark, dict.fromkeys(gone, "")), LAYOUT)
        assert before <= files(spark, f"{path}/segments")  # nothing stored before is touched
        stages.append(dict(state))
    return path, stages


def parsed(spark):
    return S.parse(spark.createDataFrame(list(QUERIES.items()), "query_id long, query string"))


def check(spark, path, docs, k=4):
    hits = SEG.segment_hits(spark, path, S.terms_of(parsed(spark)))
    for mode, match in (("all", S.match_all), ("any", S.match_any)):
        assert as_dict(match(parsed(spark), hits)) == pytest.approx(brute((docs, QUERIES), mode), abs=1e-6)
    want = brute_top(brute((docs, QUERIES), "any"), k)
    for seeds in (1, 3, None):
        found = SEG.top_stored(spark, path, parsed(spark), k, LAYOUT, seeds=seeds)
        assert {(r.query_id, r.doc_id, r.rank) for r in found.top.collect()} == want
    return found


def test_search_after_replacements_equals_a_rebuild(spark, built):
    path, stages = built
    found = check(spark, path, stages[-1])
    assert found.seeds.count() + found.needed.count() < found.bounds.count()  # some slots are never read


def test_a_repeated_batch_changes_nothing(spark, built):
    path, stages = built
    before = files(spark, path)
    assert not SEG.add_batch(frame(spark, {1: "sun"}), "doc_id", ["text"], path, "b", layout=LAYOUT)
    assert files(spark, path) == before


def test_merges_rewrite_one_size_class_and_keep_results(spark, built):
    path, stages = built
    _, state = commits.read_state(spark, path)
    names = [s["name"] for s in state["segments"]]
    sizes = {s["name"]: s["n"] - s["dead_n"] for s in state["segments"]}
    before = files(spark, f"{path}/segments")
    merged = SEG.merge_tiers(spark, path, LAYOUT)
    assert merged == [] or set(merged) < set(names)
    rng = random.Random(12)
    extra = texts_of(rng, range(200, 220))
    more = texts_of(rng, range(220, 240))
    for name, docs in (("e", extra), ("f", more)):
        SEG.add_batch(frame(spark, docs), "doc_id", ["text"], path, name, layout=LAYOUT)
    merged = SEG.merge_tiers(spark, path, LAYOUT)
    assert len(merged) >= 3 and names[0] not in merged and sizes[names[0]] > 80
    assert before <= files(spark, f"{path}/segments")  # old segments stay for their readers
    check(spark, path, stages[-1] | extra | more)
    assert SEG.vacuum(spark, path) > 0 and SEG.vacuum(spark, path) == 0
    check(spark, path, stages[-1] | extra | more)
    kept = {f for f in before if f"/{names[0]}/" in f[0]}
    assert kept and kept <= files(spark, f"{path}/segments")


def test_an_uncommitted_batch_does_not_count(spark):
    path = new_path(spark, "segments")
    docs = {1: "sun moon", 2: "the sun"}
    SEG.add_batch(frame(spark, docs), "doc_id", ["text"], path, "a", layout=LAYOUT)
    number, state = commits.read_state(spark, path)
    frame(spark, {9: "x"}).write.parquet(f"{path}/segments/{number + 1:010d}/texts")  # a writer died here
    check(spark, path, docs)
    SEG.add_batch(frame(spark, {2: "moon"}), "doc_id", ["text"], path, "b", layout=LAYOUT)
    check(spark, path, {1: "sun moon", 2: "moon"})
    with pytest.raises(commits.CommitConflict):
        commits.commit(spark, path, number, state)
    SEG.add_batch(None, "doc_id", ["text"], path, "c", frame(spark, {1: "", 2: ""}), LAYOUT)
    assert SEG.top_stored(spark, path, parsed(spark), 3, LAYOUT).top.count() == 0
    with pytest.raises(ValueError):
        SEG.segment_hits(spark, new_path(spark, "nothing"), S.terms_of(parsed(spark)))


def scanned(df) -> int:
    """Rows that the scans of a collected plan handed on."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan)
    while todo:
        node = todo.pop()
        for child in ("plan",) if "QueryStage" in node.getClass().getName() else ():
            todo.append(getattr(node, child)())
        if "FileSourceScan" in node.getClass().getName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_ranges_of_slots_skip_row_groups(spark):
    """A frequent term spans many row groups; a search reads those that hold its slots."""
    path = new_path(spark, "segments")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the common words of all "), F.col("id").cast("string")).alias("text"))
    small = {"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.page.row.count.limit": "20"}
    conf = spark._jsc.hadoopConfiguration()
    for k, v in small.items():
        conf.set(k, v)
    try:
        SEG.add_batch(docs, "doc_id", ["text"], path, "a", layout=SEG.Layout(slot_docs=16))
    finally:
        for k in small:
            conf.unset(k)
    state = commits.read_state(spark, path)[1]["segments"][0]
    blocks = spark.read.parquet(f"{path}/segments/{state['name']}/blocks").filter(F.col("term") == "common")
    whole = scanned(blocks.select("slot", "n"))
    part = blocks.filter(SEG.slot_ranges([3, 4, 40], 20)).select("slot", "n")
    assert "GreaterThanOrEqual(slot" in part._jdf.queryExecution().executedPlan().toString()
    assert blocks.count() == 1250 and 0 < scanned(part) < whole / 2
