"""Every stage of the corpus pipeline, and all of them, on small tables with awkward rows."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score string, leaks string, size string, shard string, "
    "target double, taken string, taken_from string, taken_by_shard string, extra map<string, string>, __content string"
)
ITEM = "what is the boiling point of water at the top of the highest mountain of the world"
LONG = "word of a long text " * 20_000


def row(doc_id, text, source="a", **own):
    return {
        "doc_id": doc_id, "text": text, "lang": None, "source": source, "n_chars": None if text is None else len(text), "score": "s", "leaks": "l", "size": "z",
        "shard": "h", "target": 0.5, "taken": "t", "taken_from": "f", "taken_by_shard": "b", "extra": {"k": str(doc_id)}, "__content": "c", **own,
    }


def prose(seed, n=60):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("aeinorst") for _ in range(draw.randint(2, 8))) for _ in range(n))


ROWS = [
    row(1, None),
    row(2, "", None),
    row(3, " \n\t"),
    row(None, None),
    row(4, LONG),
    row(5, prose(5)),
    row(5, prose(5)),
    row(6, prose(5) + " end", "b"),
    row(7, prose(7), "b", extra=None),
    row(8, prose(8) + " " + ITEM + " " + prose(9), "c"),
    row(None, prose(10), None),
    row(None, prose(10), None),
    *[row(100 + k, prose(100 + k), "abc"[k % 3]) for k in range(40)],
    *[row(200 + k, prose(200 + k) + " you numbskull", "b") for k in range(20)],
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(100 + k, 1, 0) for k in range(40)] + [(200 + k, 0, 1) for k in range(20)] + [(None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(rows):
    return Counter(str(tuple(r)) for r in rows)


def stage(spark, name, folder, docs=None):
    docs = spark.read.parquet(f"{folder}/documents.parquet") if docs is None else docs
    return docs, dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:3]])
def test_filters_return_rows_as_they_came(spark, folder, name):
    docs, out = stage(spark, name, folder)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert not plain(out.collect()) - plain(docs.collect())


def test_toxic_documents_go_and_others_stay(spark, folder):
    _, out = stage(spark, "toxicity", folder)
    kept = Counter(r["doc_id"] for r in out.collect())
    assert sum(1 for k in range(200, 220) if k in kept) <= 2
    assert {d: n for d, n in kept.items() if d is None or d < 200} == Counter(r["doc_id"] for r in ROWS if r["doc_id"] is None or r["doc_id"] < 200)


def test_one_document_of_each_group_stays(spark, folder):
    _, out = stage(spark, "near_duplicates", folder)
    kept = Counter(r["doc_id"] for r in out.collect())
    # 1, 2, 3 and the null text hold no word and are one group; 5 leads its copies; a row without key leads only its own
    assert kept[1] == 1 and not kept[2] and not kept[3]
    assert kept[5] == 1 and not kept[6] and kept[4] == kept[7] == kept[8] == 1
    assert kept[None] == 1 and all(kept[k] == 1 for k in (*range(100, 140), *range(200, 220)))


def test_documents_with_items_go(spark, folder):
    docs, out = stage(spark, "decontamination", folder)
    assert plain(out.collect()) == plain(docs.where("doc_id is null or doc_id <> 8").collect())


def test_the_mix_keeps_all_columns(spark, folder):
    docs, out = stage(spark, "mixing", folder)
    assert out.schema.simpleString() == docs.schema.simpleString()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r)
    words = Counter()
    for r in out.collect():
        assert any(r["text"].strip() in x["text"] or set(r["text"].split()) <= set(x["text"].split()) for x in texts[r["doc_id"]] if x["text"])
        assert r["n_chars"] == len(r["text"]) and (r["score"], r["size"], r["target"], r["taken"], r["shard"]) == ("s", "z", 0.5, "t", "h")
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert set(words) == {None, "a", "b", "c"}


def test_shards_hold_every_row(spark, folder):
    docs, out = stage(spark, "sharding", folder)
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"]
    rows = out.collect()
    assert plain(r[:-2] for r in map(tuple, rows)) == plain(map(tuple, docs.drop("shard").collect()))
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(24)) <= 1


def test_all_stages_on_the_small_tables(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    kept = {r["doc_id"] for r in out.collect()}
    assert kept <= {4, 5, 7, None, *range(100, 140), *range(200, 220)}
    assert sum(1 for k in range(200, 220) if k in kept) <= 2 and len([k for k in kept if k and 100 <= k < 140]) > 20
    again = corpus_pipeline.run(spark, folder)
    strip = lambda rows: Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows)
    assert strip(again.collect()) == strip(out.collect())


def test_empty_tables_give_empty_results(spark, bare):
    for name, _ in corpus_pipeline.STAGES:
        docs, out = stage(spark, name, bare)
        assert out.count() == 0 and set(docs.columns) <= {*out.columns}
    assert corpus_pipeline.run(spark, bare).count() == 0


def test_stages_call_the_operators_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None
