"""Dates, files and lookups on small literals."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.functions import dates
from reviewlens.sources import files


@pytest.mark.parametrize(
    "text, locale, want",
    [
        ("11/04/2023", "com", (2023, 11, 4)),
        ("11/04/2023", "co.uk", (2023, 4, 11)),
        ("17. Marz 2021", "de", (2021, 3, 17)),
        ("Avis du 9 décembre 2022", "fr", (2022, 12, 9)),
        ("2022年11月30日", "co.jp", (2022, 11, 30)),
        ("2022.11.3", "co.jp", (2022, 11, 3)),
        ("31/04/2022", "fr", None),
        ("June 5, 2022", "nowhere", None),
        (None, "com", None),
    ],
)
def test_dates(text, locale, want):
    assert dates.read_date(text, locale) == (want and dt.date(*want))


@pytest.mark.parametrize(
    "text, locale, want",
    [
        ("3 juil. 2024", "fr", (2024, 7, 3)),
        ("5 sept. 2024", "es", (2024, 9, 5)),
        ("Sept 5, 2024", "com", (2024, 9, 5)),
        ("12 mrt 2024", "nl", (2024, 3, 12)),
        ("7 października 2023", "pl", (2023, 10, 7)),
        ("4 août 2022", "ca", (2022, 8, 4)),
        ("2024-02-29", "nowhere", (2024, 2, 29)),
        ("on 2024-02-29", "com", None),
        ("1/2/24", "de", (2024, 2, 1)),
        ("2024/3/9", "co.jp", (2024, 3, 9)),
        ("March 2024", "com", None),
    ],
)
def test_more_dates(text, locale, want):
    assert dates.read_date(text, locale) == (want and dt.date(*want))


@pytest.mark.parametrize(
    "text, locale, want",
    [
        ("a month ago", "com", ((2026, 2, 28), "month")),
        ("3 weeks ago", "com", ((2026, 3, 10), "week")),
        ("1001 days ago", "com", None),
        ("12 minutes ago", "com", ((2026, 3, 31), "day")),
        ("il y a 2 ans", "fr", ((2024, 3, 31), "year")),
        ("vor einem Tag", "de", ((2026, 3, 30), "day")),
        ("hace 2 meses", "es", ((2026, 1, 31), "month")),
        ("rok temu", "pl", ((2025, 3, 31), "year")),
        ("há 4 dias", "com.br", ((2026, 3, 27), "day")),
        ("3日前", "co.jp", ((2026, 3, 28), "day")),
        ("gisteren", "nl", ((2026, 3, 30), "day")),
        ("2 weeks", "com", None),
        ("ago", "com", None),
        ("yesterday", "nowhere", None),
    ],
)
def test_relative_dates(text, locale, want):
    assert dates.relative_date(text, locale, dt.date(2026, 3, 31)) == (want and (dt.date(*want[0]), want[1]))


def test_date_columns(spark):
    rows = spark.createDataFrame([("yesterday", "com"), ("11/04/2023", "com"), ("?", "com"), (None, "com")], "t string, l string")
    got = [tuple(r["x"]) for r in rows.select(dates.reading(F.col("t"), F.col("l"), dt.date(2026, 1, 2)).alias("x")).collect()]
    assert got == [(dt.date(2026, 1, 1), "day"), (dt.date(2023, 11, 4), "exact"), (None, None), (None, None)]
    assert [r[0] for r in rows.select(dates.date("t", "l")).collect()][1] == dt.date(2023, 11, 4)


def test_labels(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"fixture":"a","label":1}\n\n{"fixture":"b","label":0}\n')
    assert files.read_labels(spark, str(good)).count() == 2
    for bad in ('{"fixture":"a","label":2}', '{"label":1}', "{", '{"fixture":"a","label":1}\n{"fixture":"a","label":1}'):
        path = tmp_path / f"{abs(hash(bad))}.jsonl"
        path.write_text(bad)
        with pytest.raises(ValueError):
            files.read_labels(spark, str(path))


def test_lexicon():
    tokens, vectors = ["a", "b"], np.array([[3.0, 4.0], [1.0, 0.0]])
    data = files.build_lexicon(tokens, vectors)
    names, back = files.parse_lexicon(data)
    assert names == tokens and np.abs(back - np.array([[0.6, 0.8], [1.0, 0.0]])).max() < 0.01
    with pytest.raises(ValueError):
        files.parse_lexicon(data[:-1])
    assert files.fit_tokens([1, 1], 2, len(data) * 4 // 3 + 4) == 2 and files.fit_tokens([1, 1], 2, 10) == 0


def test_vectors_and_snapshots(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("3 2\ncat 1 2\ndog 3 4\ncat 5 6\nnot-one 1 1\n")
    assert sorted((r["token"], r["vec"]) for r in files.read_vectors(spark, str(path)).collect()) == [("cat", [1.0, 2.0]), ("dog", [3.0, 4.0])]
    root = str(tmp_path / "snap")
    for i in range(4):
        files.snapshot(spark.range(i + 1), root, 1_000_000_000 + i, keep=2)
    assert len(files.snapshots(spark, root)) == 2 and files.restore(spark, root).count() == 4


def test_examples(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text(json.dumps({"exampleId": "1", "features": {"a": 0.5, "b": None}, "label": 1, "metadata": {}}) + "\n")
    row = files.load_examples(spark, str(path)).first()
    assert row["features"] == {"a": 0.5, "b": None} and row["label"] == 1
