"""Every operator and stage gives the same result however its tables are dealt to files and tasks."""

import os

import pytest

import corpus_pipeline
from lexloom.llm import packing
from lexloom.llm.queries import QUERIES

FILES = {"documents": 60, "embeddings": 20, "conversations": 20, "labels": 5}
#: What a packing decides freely.
PLACES = ("sequence_id", "offset")


@pytest.fixture(scope="module")
def dealt(spark, tables, tmp_path_factory):
    """The smallest tables in many files, each file a partition."""
    where = tmp_path_factory.mktemp("dealt")
    for name in os.listdir(tables):
        files = FILES.get(name.removesuffix(".parquet"))
        if files:
            spark.read.parquet(f"{tables}/{name}").repartition(files).write.parquet(str(where / name))
        else:
            os.symlink(f"{tables}/{name}", where / name)
    return str(where)


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "65536")
    spark.conf.set(keys[1], "65536")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df):
    columns = sorted(c for c in df.columns if c not in PLACES)
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def check_places(df):
    """Sequences are filled without gaps, and none beyond the window."""
    ends = {}
    for r in sorted(df.select("sequence_id", "offset", "length").collect()):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert set(ends) == set(range(len(ends))) and max(ends.values()) <= packing.WINDOW


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_files_do_not_matter(spark, tables, dealt, small_splits, name):
    many = QUERIES[name](spark, dealt)
    if name == "op8_packing":
        check_places(many)
    assert rows(many) == rows(QUERIES[name](spark, tables))


@pytest.mark.parametrize("partitions", [1, 12, 40, 200])
def test_packing_places_are_taken_once(spark, tables, partitions):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(120)
    check_places(packing.pack(docs.repartition(partitions)))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_do_not_depend_on_tasks(spark, tables, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    one, many = (stage[1](spark, docs.repartition(n), tables) for n in (1, 40))
    if stage[1] is corpus_pipeline.packed:
        check_places(many)
    assert rows(one) == rows(many)
