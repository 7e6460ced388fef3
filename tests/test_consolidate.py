import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stratawave.operators import consolidate as c
from stratawave.operators import file_footer as ff


def write(folder, name, table, **more):
    folder.mkdir(exist_ok=True)
    pq.write_table(table, folder / name, **more)


def test_many_files_become_few_without_loss(spark, tmp_path):
    source = tmp_path / "in"
    rows = []
    for i in range(60):
        part = [{"id": i * 10 + k, "text": None if k == 1 else f"t{k}", "data": [float(k)] * (k % 3)} for k in range(i % 4)]
        rows += part
        write(source, f"{i}.parquet", pa.Table.from_pylist(part, pa.schema([("id", pa.int64()), ("text", pa.string()), ("data", pa.list_(pa.float64()))])), compression=["zstd", "snappy"][i % 2], use_dictionary=bool(i % 3), write_page_index=True)
    report = c.consolidate(spark, str(source), str(tmp_path / "out"), target_bytes=20_000).collect()
    assert sum(r.rows for r in report) == len(rows) and sum(r.sources for r in report) == 60 and 1 < len(report) < 10
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.text, list(r.data)) for r in back.collect()) == sorted(((r["id"], r["text"], r["data"]) for r in rows), key=lambda r: r[0])
    assert back.filter("id >= 300 AND id < 310").count() == sum(300 <= r["id"] < 310 for r in rows)  # the statistics moved along
    assert sorted(x for f in (tmp_path / "out").iterdir() for x in pq.read_table(f)["id"].to_pylist()) == sorted(r["id"] for r in rows)
    assert len(list(source.iterdir())) == 60


def test_schemas_and_broken_files(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "a.parquet", pa.table({"x": [1]}))
    write(source, "b.parquet", pa.table({"x": ["one"]}))
    (source / "c.parquet").write_bytes(b"no such thing")
    (source / "d.parquet").write_bytes(b"")
    report = c.consolidate(spark, str(source), str(tmp_path / "out")).collect()
    assert sorted(r.rows for r in report if not r.refused) == [1, 1]
    assert {r.file[-9:] for r in report if r.refused} == {"c.parquet"}


def test_empty_folder_and_single_file(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert c.consolidate(spark, str(tmp_path / "none"), str(tmp_path / "out0")).count() == 0
    pq.write_table(pa.table({"x": list(range(10))}), tmp_path / "one.parquet")
    table, report = c.consolidated(spark, str(tmp_path / "one.parquet"))
    assert table.count() == 10 and report.first().blocks == 1


VALUES = st.recursive(
    st.one_of(st.tuples(st.just(ff.I64), st.integers(-(2**62), 2**62)), st.tuples(st.just(ff.I32), st.integers(-(2**31), 2**31 - 1)), st.tuples(st.just(ff.BINARY), st.binary(max_size=20)), st.tuples(st.just(ff.TRUE), st.booleans()), st.tuples(st.just(ff.DOUBLE), st.floats(allow_nan=False))),
    lambda inner: st.one_of(
        st.lists(st.tuples(st.integers(1, 40), inner), max_size=5, unique_by=lambda f: f[0]).map(lambda fs: (ff.STRUCT, [[n, k, v] for n, (k, v) in sorted(fs, key=lambda f: f[0])])),
        st.lists(st.integers(-9, 9), max_size=20).map(lambda xs: (ff.LIST, (ff.I32, xs))), st.lists(st.booleans(), max_size=20).map(lambda xs: (ff.LIST, (ff.TRUE, xs))),
    ),
)


def plain(kind, value):
    if kind == ff.STRUCT:
        return [(n, plain(k, v)) for n, k, v in value]
    return value


@given(VALUES)
def test_footer_round_trip(pair):
    kind, value = pair
    wrapped = [[1, kind, value]]
    again = ff.Reader(ff.encoded(ff.STRUCT, wrapped)).value(ff.STRUCT)
    assert plain(ff.STRUCT, again) == plain(ff.STRUCT, wrapped)


def test_fragment_roles(spark, tmp_path):
    message = spark.createDataFrame(
        [("s", "t", 1, 10), ("s", "t", 2, 10), ("s", "t", 1, 11), ("s", "t", 3, 11), ("s", "t", 1, 12), ("s", "t", 2, 12), ("u", "t", 1, 13), ("u", "t", 2, 14), ("u", "t", 2, 14), ("s", "t", None, 15), (None, None, 5, 16), ("s", "t", 9, None)],
        "source_uri string, topic string, msg_id long, fragment_id long",
    )
    fragment = spark.createDataFrame([(i,) for i in (10, 11, 12, 13, 14, 15, 16, 17, 17)], "fragment_id long")
    got = {r.fragment_id: r.role for r in c.fragment_roles(fragment, c.compact_records(message, str(tmp_path / "out"))).collect()}
    assert got == {10: "copy", 11: "rewrite", 12: "drop", 13: "copy", 14: "rewrite", 15: "copy", 16: "copy", 17: "drop"}
    assert c.fragment_roles(fragment.limit(0), c.compact_records(message.limit(0), str(tmp_path / "none"))).count() == 0


@given(st.lists(st.tuples(st.sampled_from("st"), st.sampled_from([None, 1, 2, 2 << 16, -5]), st.integers(0, 4)), max_size=30))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_roles_and_files_against_brute_force(spark, tmp_path, rows):
    import uuid

    rows = [(topic, i, f, i) for topic, i, f in rows]
    df = spark.createDataFrame([("s", *r) for r in rows], "source_uri string, topic string, msg_id long, fragment_id long, extra long")
    out = str(tmp_path / uuid.uuid4().hex)
    report = c.compact_records(df, out, target_rows=7)
    fragments = spark.createDataFrame([(f,) for f in range(6)], "fragment_id long")
    got = {r.fragment_id: (r.held, r.owned) for r in c.fragment_roles(fragments, report).collect()}
    held = {f: {(t, i) for t, i, g, _ in rows if g == f} for f in range(6)}
    assert got == {f: (len(h), len([x for x in h if not any(x in held[g] for g in range(f))])) for f, h in held.items()}
    if rows:
        back = spark.read.parquet(out).collect()
        assert sorted(map(repr, [(r.topic, r.msg_id, r.fragment_id) for r in back])) == sorted(map(repr, {x: (*x, min(f for f in held if x in held[f])) for h in held.values() for x in h}.values()))


def test_pages_of_small_blocks_are_joined(spark, tmp_path):
    schema = pa.schema([("id", pa.int64()), ("big", pa.uint32()), ("text", pa.string()), ("data", pa.list_(pa.float64()))])
    rows = []
    for i in range(40):
        part = [{"id": i * 10 + k, "big": (3_000_000_000 if i % 2 else 5) + k, "text": None if k == 1 else f"t{i}", "data": [float(k)] * (k % 3)} for k in range(1 + i % 4)]
        rows += part
        write(tmp_path / "in", f"{i}.parquet", pa.Table.from_pylist(part, schema), use_dictionary=False, compression="zstd", row_group_size=2)
    (report,) = c.consolidate(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert (report.sources, report.blocks, report.rows) == (40, 1, len(rows))
    key = lambda r: r["id"]
    assert sorted(pq.read_table(report.file).to_pylist(), key=key) == rows
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("big > 2000000000").count() == sum(r["big"] > 2e9 for r in rows) and back.filter("id = 391").count() == 1 and back.filter("text = 't7'").count() == 3
    found = pq.read_metadata(report.file).row_group(0)
    assert (found.column(0).statistics.min, found.column(0).statistics.max) == (0, 393) and not found.column(1).statistics.has_min_max


def test_out_of_reach(spark, tmp_path):
    with pytest.raises(Exception):
        c.consolidate(spark, str(tmp_path / "absent"), str(tmp_path / "out")).collect()


def test_every_record_once(spark, tmp_path):
    rows = [("s", "t", i, f, "x" * (i % 5), [float(i)]) for i in range(50) for f in ([i // 5] if i % 7 else [i // 5, 90 + i % 3, 90 + i % 3])]
    rows += [("u", "t", 3, None, None, None), ("s", None, 1, 1, "a", []), ("s", "t", None, 4, "n", None), ("s", "t", None, 5, "n", None)]
    df = spark.createDataFrame(rows, "source_uri string, topic string, msg_id long, fragment_id long, record_block string, data array<double>")
    report = c.compact_records(df, str(tmp_path / "out"), target_rows=20).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    files = [r for r in report if r.file]
    assert sum(r.rows for r in files) == back.count() == 53 and {r.topic for r in report} == {"t", None} and len(files) == len(list((tmp_path / "out").iterdir())) > 2
    assert back.groupBy("source_uri", "topic", "msg_id").count().filter("count > 1").count() == 0
    assert {r.fragment_id for r in back.filter("msg_id = 7 AND topic = 't'").collect()} == {1} and back.filter("msg_id IS NULL").first().fragment_id == 4
    assert c.compact_records(df.limit(0), str(tmp_path / "none")).count() == 0


def test_records_without_id_are_told_apart(spark, tmp_path):
    rows = [("s", "t", None, 1, 1, 5.0, [1.0]), ("s", "t", None, 2, 1, 6.0, [2.0]), ("s", "t", None, 2, 2, 7.0, [2.0]), ("s", "t", None, 1, 3, 8.0, [1.0]), ("s", "t", 7, 7, 2, 9.0, [1.0])]
    df = spark.createDataFrame(rows, "source_uri string, topic string, msg_id long, seq long, fragment_id long, received_at double, data array<double>")
    report = c.compact_records(df, str(tmp_path / "out"))
    roles = {r.fragment_id: (r.held, r.owned, r.role) for r in c.fragment_roles(df.select("fragment_id"), report).collect()}
    assert roles == {1: (2, 2, "copy"), 2: (2, 1, "rewrite"), 3: (1, 0, "drop")}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3 and sorted((r.seq, r.fragment_id) for r in back.collect()) == [(1, 1), (2, 1), (7, 2)]


def test_refused_files_do_not_vanish(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    write(source, "a.parquet", pa.table({"x": [1, 2]}))
    write(source, "b.parquet", pa.table({"x": [3]}))
    real = c.consolidate

    def half(spark, source, out, target_bytes):
        refused = spark.createDataFrame([(f"{source}/b.parquet", None, 1, 0, 0, 0, "encrypted")], c.REPORT)
        return real(spark, f"{source}/a.parquet", out, target_bytes).unionByName(refused)

    monkeypatch.setattr(c, "consolidate", half)
    assert sorted(r.x for r in c.consolidated(spark, str(source))[0].collect()) == [1, 2, 3]
    monkeypatch.setattr(c, "consolidate", real)
    (source / "c.parquet").write_bytes(b"no Parquet file at all")
    with pytest.raises(Exception):
        c.consolidated(spark, str(source))[0].count()
    monkeypatch.setattr(c, "footer_rows", lambda batches: (b.assign(rows=9)[["path", "rows"]] for b in batches))
    with pytest.raises(ValueError, match="3 files with 3 rows were seen to of 3 files with 18 rows"):
        c.consolidate(spark, str(source), str(tmp_path / "out"))


def test_store_keeps_what_it_cannot_compact(spark, tmp_path):
    from stratawave.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame([("a", 1.0, [1.0]), ("a", 2.0, [2.0])], "topic string, ts double, data array<double>"))
    odd = tmp_path / "s" / "data" / "topic=a" / "odd.parquet"
    odd.write_bytes(b"no Parquet file at all")
    with pytest.raises(ValueError, match="odd.parquet"):
        store.compact()
    assert odd.exists() and not list((tmp_path / "s").glob("data-*"))
    odd.unlink()
    assert store.messages().count() == 2
