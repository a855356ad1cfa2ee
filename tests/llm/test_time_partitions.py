import datetime as dt
import hashlib
import os
import random
import zlib

import pyarrow.parquet as pq
import pytest

from quillspark.llm import queries, time_partitions

CUT = dt.datetime(2024, 5, 1)


def moment(row):
    i, ts = row[:2]
    if ts is None or i is None:
        return ts
    k = zlib.crc32(str(i).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time())
    return ts


def children(first, level):
    """(name, first, end) of a node's members."""
    if level == 1:
        begins = [first.replace(month=m) for m in range(1, 13)] + [first.replace(year=first.year + 1)]
    elif level == 2:
        end = (first + dt.timedelta(days=32)).replace(day=1)
        begins = [first + dt.timedelta(days=d) for d in range((end - first).days + 1)]
    else:
        begins = [first + dt.timedelta(hours=h) for h in range(25)]
    base = 0 if level == 3 else 1
    return [(f"{i + base:02d}", a, b) for i, (a, b) in enumerate(zip(begins, begins[1:], strict=False))]


def leaves(members, level, stem, rows, most):
    runs, last = [], False
    for name, a, b in members:
        inside = [r for r in rows if a <= moment(r) < b]
        if len(inside) > most and level < 3:
            yield from leaves(children(a, level + 1), level + 1, f"{stem}{name}/", inside, most)
            last = False
        elif len(inside) > most:
            runs.append([name, name, inside])
            last = False
        elif last and len(runs[-1][2]) + len(inside) <= most:
            runs[-1][1:] = name, runs[-1][2] + inside
        else:
            runs.append([name, name, inside])
            last = True
    yield from ((f"{stem}{x}-{y}", r) for x, y, r in runs if r)


def layout(rows, most):
    """{(leaf, part): rows in order}"""
    dated = [r for r in rows if r[1] is not None]
    years = [moment(r).year for r in dated]
    members = [(f"{y:04d}", dt.datetime(y, 1, 1), dt.datetime(y + 1, 1, 1)) for y in range(min(years), max(years) + 1)] if years else []
    all_leaves = [*leaves(members, 0, "", dated, most), ("null", [r for r in rows if r[1] is None])]
    late = lambda x: (x is None, x or 0)
    time = lambda x: (x is None, x or CUT)
    out = {}
    for leaf, inside in all_leaves:
        inside = sorted(inside, key=lambda r: (time(moment(r)), time(r[2]), late(r[0])))
        out |= {(leaf, p // most + 1): inside[p : p + most] for p in range(0, len(inside), most)}
    return out


def ids(rows):
    return hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in rows).encode()).hexdigest()


def check(spark, rows, extra, root, parts):
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, value int" + "".join(f", `{c}` string" for c in extra)
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(5)
    got = time_partitions.time_partitions(df, "2024-05-01 00:00:00", f"file://{root}", parts=parts).collect()
    most = 1 + len(rows) // parts
    start, final = layout([r for r in rows if r[2] is not None and r[2] < CUT], most), layout(rows, most)
    assert {(r.leaf, r.part) for r in got} == set(final) and len(got) == len(final)
    on_disk = {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}
    assert on_disk == {r.path.removeprefix("file:") for r in got}
    for r in got:
        want = final[r.leaf, r.part]
        new = [x for x in want if x[2] is None or x[2] >= CUT]
        stays = sorted(start.get((r.leaf, r.part), []), key=str) == sorted(want, key=str)
        assert (r.columns, r.n_rows, r.n_new, r.ids_sha256, r.rewritten) == (",".join(df.columns), len(want), len(new), ids(want), not stays), r
        file = pq.ParquetFile(r.path.removeprefix("file:")).read()
        assert file.column_names == df.columns and file.column("click_id").to_pylist() == [x[0] for x in want]
        assert sorted(zip(*(file.column(c).to_pylist() for c in ("click_id", "ts", "arrived_at", "value")), strict=True), key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_layouts_are_brute_force(spark, tmp_path, seed):
    rnd, rows = random.Random(seed), []
    for i in range(700):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(150 * 86400), microseconds=rnd.randrange(10**6))
        if rnd.random() < 0.3:
            ts = dt.datetime(2024, 2, 29, 13, 5, rnd.randrange(60))
        arrived = ts + dt.timedelta(minutes=rnd.choice([0, 1, 5, 90]))
        # New rows late in time, so that other files stay.
        arrived = None if rnd.random() < 0.01 and ts > dt.datetime(2024, 4, 1) else dt.datetime(2024, 5, 3) if rnd.random() < 0.03 and ts > dt.datetime(2024, 3, 10) else arrived
        rows.append((i if rnd.random() > 0.02 else None, ts if rnd.random() > 0.06 else None, arrived, rnd.randrange(5)))
    rows += [rows[3]] * 40 + rows[:30]
    got = check(spark, rows, ["time", "_time", "by_file", "LEAF", "a.b"], str(tmp_path), 20 + 20 * seed)
    assert {r.rewritten for r in got} == {True, False} and any(r.part > 1 for r in got) and any(r.leaf.count("/") == 3 for r in got)


def test_odd_tables(spark, tmp_path):
    assert check(spark, [], [], str(tmp_path / "empty"), 500) == []
    (one,) = check(spark, [(1, None, None, 1)], [], str(tmp_path / "null"), 500)
    assert (one.leaf, one.part, one.n_new, one.rewritten) == ("null", 1, 1, True)
    same = (7, dt.datetime(2024, 2, 1, 3), dt.datetime(2024, 2, 1, 4), 1)
    got = check(spark, [same] * 50 + [(None, dt.datetime(1999, 12, 31), None, None)], [], str(tmp_path / "same"), 10)
    assert max(r.part for r in got) == 9


def test_folding():
    assert list(time_partitions.folded([1, 1, 1, 5, 0, 0, 2, 9, 9, 0], 3)) == [(0, 2, 3), (3, 3, 5), (4, 6, 2), (7, 7, 9), (8, 8, 9), (9, 9, 0)]
    assert list(time_partitions.folded([], 3)) == []


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "clicks").select("click_id", "ts", "arrived_at").collect()]
    want = layout(rows, 1 + len(rows) // 500)
    got = queries.op11_time_partitions(spark, sf).collect()
    assert {(r.leaf, r.part): (r.n_rows, r.ids_sha256) for r in got} == {f: (len(x), ids(x)) for f, x in want.items()}
    before = layout([r for r in rows if r[2] and r[2] < CUT], 1 + len(rows) // 500)
    assert {(r.leaf, r.part): r.rewritten for r in got} == {f: sorted(before.get(f, []), key=str) != sorted(x, key=str) for f, x in want.items()}
