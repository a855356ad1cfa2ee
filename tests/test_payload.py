import datetime as dt
import random

import pytest

from quillspark.operators import payload, retrieval

SCHEMA = "chunk_id string, folder string, created date, tags array<string>, text string"
DAY = dt.date(2024, 1, 1)


def rows(n, seed, hot=0.33):
    rnd, out = random.Random(seed), []
    for i in range(n):
        folder = "big" if rnd.random() < hot else rnd.choice([None, "", *(f"f{j}" for j in range(40))])
        created = None if rnd.random() < 0.05 else DAY + dt.timedelta(rnd.randrange(365))
        tags = rnd.choice([None, [], [None], ["x", f"t{rnd.randrange(20)}"], [f"only-{i // 50}"]])
        out.append((f"c{i}", folder, created, tags, f"text {i}"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_filters_pick_files_and_lose_no_row(spark, tmp_path, seed):
    df = spark.createDataFrame(rows(4000, seed), SCHEMA).repartition(5)
    index = payload.Payload.write(df, f"{tmp_path}/p", file_rows=50)
    stats = index.files().collect()
    assert len(stats) > 60 and sum(s.n for s in stats) == 4000 and max(s.n for s in stats) < 400
    rnd, share = random.Random(seed), {}
    for _ in range(4):
        after, width = DAY + dt.timedelta(rnd.randrange(330)), rnd.choice([0, 10, 60])
        for kind, f in {
            "both": {"folder": rnd.choice(["big", "f3", "", "none"]), "after": after, "before": after + dt.timedelta(width)}, "folder": {"folder": f"f{rnd.randrange(40)}"},
            "tag": {"tags": [f"only-{rnd.randrange(80)}", "absent"]}, "open": {"before": after}, "all": {},
        }.items():
            counted = {}
            got = sorted(map(tuple, index.filtered(**f, counted=counted).collect()), key=repr)
            assert got == sorted(map(tuple, retrieval.filtered(df, **f).collect()), key=repr)
            share.setdefault(kind, []).append(counted["read"] / counted["files"])
    mean = {k: sum(v) / len(v) for k, v in share.items()}
    assert mean["all"] == 1 and mean["both"] < 0.15 and mean["folder"] < 0.5 and mean["tag"] < 0.8, mean


def test_odd_tables(spark, tmp_path):
    empty = payload.Payload.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e")
    assert empty.filtered(folder="a").count() == 0 and empty.filtered().count() == 0
    nulls = spark.createDataFrame([("a", None, None, None, None)] * 3, SCHEMA)
    index = payload.Payload.write(nulls, f"{tmp_path}/n")
    assert index.filtered().count() == 3
    assert [index.filtered(**f).count() for f in ({"folder": ""}, {"after": DAY}, {"before": DAY}, {"tags": ["t"]})] == [0] * 4
    one = payload.Payload.write(spark.createDataFrame([(f"c{i}", "f", DAY, ["t"], "x") for i in range(500)], SCHEMA), f"{tmp_path}/o", file_rows=50)
    assert one.files().count() > 5 and one.filtered(["t"], "f", DAY, DAY).count() == 500
