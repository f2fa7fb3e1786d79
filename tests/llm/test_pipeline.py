"""The pipeline on planted documents, stage by stage."""

import os
import random

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_stages_have_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF).columns == docs.columns


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    key = lambda r: (r["doc_id"], list(r["ids"]))
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, SF).collect()))


def test_planted_documents(spark, tmp_path):
    """Toxic, copied and leaked documents go; clean ones stay, with personal data masked."""
    rng = random.Random(3)
    prose = lambda n: " ".join(f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.randrange(200)}" for _ in range(n))
    item = "Where does the copper bridge of Anvaro end, and who built it? It ends in Selm and was built by weavers."
    clean = [(i, prose(80)) for i in range(40)]
    clean[3] = (3, clean[3][1] + " write to a.b@example.org")
    copies = [(100 + i, clean[i][1]) for i in range(5)] + [(200 + i, clean[i][1] + " tail") for i in range(5, 10)]
    leaked = [(300, f"{prose(50)} {item} {prose(50)}")]
    labelled = [(1000 + i, f"{prose(40)} {'vile scoundrel' if i % 2 else ''} {prose(40)}", i % 2) for i in range(400)]
    toxic = [(5000 + i, f"{prose(60)} you vile scoundrel {prose(20)}") for i in range(3)]
    rows = clean + copies + leaked + [r[:2] for r in labelled] + toxic
    rng.shuffle(rows)
    full = [(i, t, "en", "src", len(t)) for i, t in rows] + [(None, None, None, None, None), (7000, "", "en", None, 0)]
    folder = str(tmp_path)
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        step(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        ids = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            assert not ids & {i for i, _ in toxic} and {i for i, _ in clean} <= ids
        if name == "near_duplicates":
            assert all(len(ids & {i, 100 + i}) == 1 for i in range(5)) and all(len(ids & {i, 200 + i}) == 1 for i in range(5, 10))
            assert {i for i in range(10, 40)} <= ids and len(ids & {None, 7000}) == 1
        if name == "decontamination":
            assert 300 not in ids and {i for i in range(10, 40)} <= ids
    masked = [r["text"] for r in docs.collect() if r["doc_id"] in (3, 103)]
    assert len(masked) == 1 and masked[0].endswith("write to [EMAIL]")
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __rid long, score string, links array<int>"


def _folder(spark, tmp_path, rows, items=(), labels=()):
    folder = str(tmp_path)
    spark.createDataFrame(list(rows), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, extra columns; no labels and no benchmark."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "mail a.b@example.org now", "en", "s", 24, 7, "x", [1]), (1, "mail a.b@example.org now", "en", "s", 24, 7, "x", [1]),
            (None, None, None, None, None, None, None, None), (2, "", "en", None, 0, 1, "y", []), (3, long, None, "s", len(long), None, None, None),
            (4, "one two three four five six", "de", "t", 27, 3, "z", None)]
    folder = _folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        sizes[name] = docs.count()
        if name != "pieces":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        if name == "pii":
            assert {r["text"] for r in docs.collect()} >= {"mail [EMAIL] now", long}
    # One of the two copies and one of the texts without words are left out.
    assert sizes == {"toxicity": 6, "near_duplicates": 4, "decontamination": 4, "pii": 4, "pieces": 4}
    assert docs.columns == ["doc_id", "lang", "source", "__rid", "score", "links", "n_ids", "ids"]


def test_empty_tables(spark, tmp_path):
    folder = _folder(spark, tmp_path, [], [(1, "What is it? It is nothing at all.")], [(1, 1, 0), (2, 0, 1)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, folder).collect() == []
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_the_rest_stands_without_this_folder():
    """Nothing else in the library names the subpackage."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, names in os.walk(root):
        if "llm" in folder or "/." in folder:
            continue
        for name in names:
            if name.endswith(".py") and name not in ("__spark_entry__.py", "corpus_pipeline.py"):
                with open(os.path.join(folder, name)) as f:
                    assert ".llm" not in f.read(), name
