import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from smilegrid.operators import archive, quotes
from smilegrid.settings import RATE_DATE

DAYS = [dt.date(2023, 3, 1) + dt.timedelta(days=k) for k in range(6)]
SCHEMA = (
    "underlying_symbol string, quote_date string, root string, expiration string, strike double, option_type string, "
    "trade_volume double, open_interest double, bid_1545 double, ask_1545 double, "
    "underlying_bid_1545 double, underlying_ask_1545 double, bid_eod double, ask_eod double, note string"
)


def raw_rows(seed, each=150):
    rng = np.random.default_rng(seed)
    rows = []
    for n, day in enumerate(DAYS):
        for k in range(each * (4 if n == 2 else 1)):  # one day holds most rows
            bid = float(rng.uniform(-0.1, 5))
            rows.append((" spx", str(day), "SPXW", "2023-09-15", 80.0 + 0.5 * (k % 300), "CP"[k % 2], float(rng.integers(0, 3)), float(rng.integers(0, 5)), bid, bid + float(rng.uniform(-0.1, 1)), 99.0, 101.0, 1.0, 2.0, None))
    rows += [rows[7]] * 120  # one contract repeated
    rows += [(None, "n/a", *[None] * 12, "x"), ("SPX", None, "SPX", "2023-09-15", 90.0, "C", 1.0, 1.0, 1.0, 2.0, 99.0, 101.0, None, None, "y")]
    return rows


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(raw_rows(5), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame([(d,) for d in DAYS[:4]], f"`{RATE_DATE}` date")


def wanted(spark, raw):
    keys = quotes.normalise_raw(raw).select("quote_date", "contract_key").where("contract_key is not null and quote_date is not null")
    pairs = [tuple(r) for r in keys.distinct().orderBy(F.xxhash64("quote_date", "contract_key")).limit(4).collect()]
    pairs += [(DAYS[0], raw_key(keys)), (dt.date(2024, 1, 1), pairs[0][1]), (DAYS[1], "SPX|SPXW|2023-09-15|1.000000|C")]
    return spark.createDataFrame(pairs, "intended_exit_date date, contract_key string")


def raw_key(keys):
    return keys.groupBy("contract_key", "quote_date").count().orderBy(F.desc("count")).first().contract_key


def rows_of(df):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_archive_keeps_every_row_and_opens_only_wanted_parts(spark, raw, rates, tmp_path):
    path = str(tmp_path / "archive")
    archive.write_archive(raw, path, rows_per_part=40)
    stored = archive.read_archive(spark, path)
    assert rows_of(stored.drop("part", "contract_key")) == rows_of(raw)

    pairs = wanted(spark, raw)
    expected = rows_of(quotes.recover_raw(raw, pairs, rates))
    assert len(expected) >= 4
    assert rows_of(archive.recover(spark, path, pairs, rates)) == expected

    # Parts that hold no wanted pair are made unreadable: a lookup must not open them.
    layout = spark.read.parquet(f"{path}/layout")
    named = quotes.as_quote_key(pairs).join(layout, "quote_date").select(archive._part(F.col("_archive_buckets")).alias("part"))
    held = {r.part for r in named.collect()}
    spoiled = 0
    for folder in Path(path, "parts").glob("part=*"):
        if folder.name[len("part="):] not in held:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"PAR1 not a table PAR1")
                Path(folder, f".{file.name}.crc").unlink(missing_ok=True)
                spoiled += 1
    assert spoiled > len(held)
    assert rows_of(archive.recover(spark, path, pairs, rates)) == expected


def test_lookups_without_hits_and_an_empty_archive(spark, raw, rates, tmp_path):
    path = str(tmp_path / "archive")
    archive.write_archive(raw, path)
    none = spark.createDataFrame([], "quote_date date, contract_key string")
    unknown = spark.createDataFrame([(dt.date(1999, 1, 1), "a"), (DAYS[0], None), (None, "b")], none.schema)
    assert archive.lookup(spark, path, none).collect() == []
    assert archive.lookup(spark, path, unknown).collect() == []
    empty = str(tmp_path / "empty")
    archive.write_archive(raw.limit(0), empty)
    assert archive.lookup(spark, empty, unknown).collect() == []
