import os
import re

import corpus_pipeline
from tests.llm.conftest import smallest_reachable
from tests.llm.test_near_texts import alike, shingles
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"start": {r.doc_id: r for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["language"], seen["quality"]
    assert len(before) > 0.99 * len(seen["start"])
    assert not any(labels.get(d) == 0 for d in after)
    sets = {d: shingles(r.text) for d, r in after.items()}
    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    root = smallest_reachable(sets, links)
    firsts = {d for d in root if root[d] == d}
    assert firsts <= set(seen["near_duplicates"]) and len(set(seen["near_duplicates"]) - firsts) <= 0.1 * (len(sets) - len(firsts))
    assert set(seen["secrets"]) == set(seen["near_duplicates"])
    for d, r in seen["secrets"].items():
        was = seen["near_duplicates"][d].text
        assert not re.search(r"password=\w{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text)
        assert r.n_chars == (len(r.text) if r.text != was else seen["near_duplicates"][d].n_chars)
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{path}/packing").collect()
    assert all(len(r.ids) == r.length for r in rows)
    assert check(rows, {d: r.text for d, r in seen["secrets"].items()}, tokenizer) < 0.02


def test_run_and_empty_tables(spark, no_docs, odd_docs, path):
    for name, docs in (("none", no_docs), ("odd", odd_docs.select(*no_docs.columns))):
        docs.write.parquet(f"{path}/{name}/documents.parquet")
        found = corpus_pipeline.run(spark, f"{path}/{name}")
        assert "sequence_id" in found.columns and (found.count() == 0) == (name == "none")


def test_stored_tables_pass(spark):
    from phrasewell.llm.common import passing_tables, stored
    from phrasewell.session import shared_dir

    def there(df):
        return df.inputFiles() and all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())

    assert shared_dir(spark)
    with passing_tables(spark) as made:
        first = stored(spark.range(3), "first")
        with passing_tables(spark):
            inner = stored(first, "inner").inputFiles()
        second = stored(first, "second")
        assert there(first) and len(made) == 2 and not any(os.path.exists(f.removeprefix("file://")) for f in inner)
        gone = first.inputFiles()
        made.pop()
    assert there(second) and second.count() == 3
    assert not any(os.path.exists(f.removeprefix("file://")) for f in gone)
