"""Pipeline stages share worker processes: a task keeps its own operator's caches and gives back those of the stages before it."""

import pickle
from types import SimpleNamespace

import pyarrow as pa

from yesterlog.llm import packing, tokens, toxicity


class _Rows:
    """Stands for a DataFrame: keeps the function that its tasks would run."""

    columns, schema = ["doc_id", "text"], None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


_BATCH = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words to keep"]})


def _both_kept():
    tokens.encoder(tokens.vocabulary("byte_bpe_50k.json")).encode("some words to keep")
    toxicity.numbers("some words to keep")
    assert tokens._encoders and toxicity._known


def test_toxicity_releases_what_packing_kept(monkeypatch):
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda docs, labels: pickle.dumps(toxicity.Model()))
    _both_kept()
    assert list(toxicity.without_toxic(_Rows(), None)(iter([_BATCH])))
    assert not tokens._encoders and toxicity._known


def test_packing_releases_what_toxicity_kept(spark, monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    _both_kept()
    own = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"))
    assert list(packing.pieces(_Rows(), tokens.vocabulary("byte_bpe_50k.json"))(iter([_BATCH])))
    assert not toxicity._known and tokens.encoder(tokens.vocabulary("byte_bpe_50k.json")) is own


def test_packing_bounds_the_rows_that_wait_in_a_worker(spark, monkeypatch):
    setting, seen, cut = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.cut

    def seeing(df, name):
        seen.append(int(spark.conf.get(setting)))
        return cut(df, name)

    monkeypatch.setattr(packing, "cut", seeing)
    before = spark.conf.get(setting)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2500)], "doc_id long, text string")
    assert packing.pack_documents(docs, tokens.vocabulary("byte_bpe_50k.json")).count() == 2500
    assert seen == [packing.BATCH] and spark.conf.get(setting) == before
