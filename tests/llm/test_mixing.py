"""Documents without an id, or that share one, are chosen each by itself."""

from collections import Counter

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _keep_row long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i % 4 == 0 else i // 3, f"row{i} " + "word " * (i % 5), "en" if i % 2 else None, f"src{i % 3}" if i % 7 else None, i, i) for i in range(26)]
    return spark.createDataFrame([*rows, *rows[:2]], COLUMNS)  # whole rows repeat too


def test_every_row_once(docs):
    from tercet.llm.mixing import mixed_documents

    got = mixed_documents(docs, percent=100, max_epochs=1)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, docs.collect()))


def test_two_epochs_repeat_rows(docs):
    from tercet.llm.mixing import mixed_documents

    got = Counter(map(tuple, mixed_documents(docs, percent=200, max_epochs=2).collect()))
    assert got == Counter({k: 2 * n for k, n in Counter(map(tuple, docs.collect())).items()})


def test_budget_holds_without_ids(docs):
    from tercet.llm.mixing import mixed_documents

    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    whole, got = docs.collect(), mixed_documents(docs, percent=50, max_epochs=1).collect()
    assert 0 < words(got) <= words(whole) // 2
    assert not Counter(map(tuple, got)) - Counter(map(tuple, whole))
