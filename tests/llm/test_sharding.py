import zlib

from quire.llm import sharding as S

SCHEMA = "doc_id long, text string, source string, lang string, shard string"


def check(rows, out, shards, slack):
    assert sorted((r._row.doc_id is None, r._row.doc_id or 0, r._size, r._crc) for r in out) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots, size = {}, [0] * shards
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r._size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size) - min(size) <= slack, size


def test_near_equal_bytes(spark):
    rows = [(i, "x" * (i * 7 % 300) + f" {i}", f"src{i % 5}" if i % 3 else "src0", ["en", "de", None][i % 3], "clash") for i in range(4000)]
    rows += [(5000 + i, "one text " * 30, "src0", "en", "") for i in range(2500)]
    out = S.shard(spark.createDataFrame(rows, SCHEMA), 24).collect()
    check(rows, out, 24, 2000)


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 400} " * 20, None, None, "") for i in range(1600)]
    out = S.shard(spark.createDataFrame(rows, SCHEMA), 7).collect()
    where = {}
    for r in out:
        where.setdefault(r._crc, set()).add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 6
    check(rows, out, 7, 3000)


def test_equal_texts_of_different_sources_stay_together(spark):
    rows = [(i, f"text {i % 400} " * 20, f"src{i % 7}", ["en", "de", None][i % 3], "") for i in range(1600)]
    out = S.shard(spark.createDataFrame(rows, SCHEMA), 7).collect()
    where = {}
    for r in out:
        where.setdefault(r._crc, set()).add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 6
    check(rows, out, 7, 3000)


def test_repeated_rows_nulls_and_long_text(spark):
    rows = [(1, "same", "s", "en", "")] * 3000 + [(None, None, None, None, None)] * 50 + [(9, "", "s", "en", "")]
    out = S.shard(spark.createDataFrame(rows, SCHEMA), 24).collect()
    check(rows, out, 24, 400)
    rows = [(i, "y" * 10, "s", "en", "") for i in range(100)] + [(1000, "9" * 3_000_000, "s", "en", "")]
    out = S.shard(spark.createDataFrame(rows, SCHEMA), 24).collect()
    check(rows, out, 24, 3_000_100)


def test_empty_table(spark):
    assert S.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(i, f"t{i}" * 9, "s", "en") for i in range(200)]
    S.write_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 200 and back.select("shard").distinct().count() == 4


def test_written_shards_keep_clashing_columns(spark, tmp_path):
    rows = [(i, f"t{i}" * 9, "mine", 7, 8, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, _size long, slot long, _row string")
    S.write_shards(docs, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == sorted([*docs.columns, "shard_"])
    assert sorted(back.select(*docs.columns).collect()) == sorted(docs.collect())


def test_cuts_are_weighted_medians_of_the_widest_dimension(spark):
    """Every node against its own rows: brute force over the compact table."""
    rows = [(i, ("word " * (i * 37 % 90) + "\n" * (i % 7) + "#" * (i % 5) + f"{i}"), f"src{i % 4}", ["en", "de"][i % 2], "") for i in range(1500)]
    table = S.compact(spark.createDataFrame(rows, SCHEMA))
    root = S.build(table, 12)
    held = [r.asDict() for r in S.assign(table, root).collect()]
    whole = [max(r[f"_d{k}"] for r in held) - min(r[f"_d{k}"] for r in held) for k in range(S.DIMS)]
    used = set()

    def visit(node, mine):
        if node.left is None:
            return
        width = [(max(r[f"_d{k}"] for r in mine) - min(r[f"_d{k}"] for r in mine)) / max(whole[k], 1) for k in range(S.DIMS)]
        assert node.dim == width.index(max(width))
        used.add(node.dim)
        left, right = [r for r in mine if r["shard"] < node.right.first], [r for r in mine if r["shard"] >= node.right.first]
        key = lambda r: r[f"_d{node.dim}"] << 32 | r["_crc"]
        assert max(map(key, left)) <= node.cut <= min(map(key, right))
        goal = sum(r["_size"] for r in mine) * node.left.count / node.count
        assert abs(sum(r["_size"] for r in left) - goal) <= max(r["_size"] for r in mine)
        assert (node.left.first, node.right.first) == (node.first, node.first + node.left.count)
        visit(node.left, left)
        visit(node.right, right)

    visit(root, held)
    assert len(used) > 2
