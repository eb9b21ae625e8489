"""Byte-range reading of JSON against the plain parser."""

import json
import random

import pytest

from tessera.sources import manifests
from tessera.sources import split_json
from tessera.sources.split_json import ByteRange, JsonReader, byte_ranges, scan_json_values, with_states


def plain(value, depth, keys=()):
    if not depth:
        yield list(keys), value
        return
    if isinstance(value, dict):
        for k, v in value.items():
            yield from plain(v, depth - 1, (*keys, k))
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from plain(v, depth - 1, (*keys, str(k)))


def anything(rng, depth):
    words = ["", "a", 'quo"te', "back\\", '\\"', "{[", "]},:", "é日 ", "x" * 40, '\\\\"\\\\\\']
    kind = rng.random()
    if depth and kind < 0.4:
        return {rng.choice(words) + str(i): anything(rng, depth - 1) for i in range(rng.randint(0, 4))}
    if depth and kind < 0.75:
        return [anything(rng, depth - 1) for _ in range(rng.randint(0, 5))]
    return rng.choice([*words, None, True, 1.5, -3])


def same(rows, want):
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(([r["keys"], json.loads(r["value"])] for r in rows), key=key) == sorted(([k, v] for k, v in want), key=key)


def local(ranges, step, depth=1):
    listed = json.dumps([[r.path, r.start, r.end, r.size, r.in_string, r.stack] for r in ranges])
    reader = JsonReader({"ranges": listed, "step": step, "depth": depth}, None)
    return [x for r in reader.partitions() for x in reader.read(r)]


@pytest.mark.parametrize("seed", range(8))
def test_every_cut_gives_the_same_values(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(split_json, "SLACK", rng.choice([2, 5, 1 << 16]))
    path, doc = tmp_path / "j.json", {str(i): anything(rng, 4) for i in range(4)}
    path.write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
    n = path.stat().st_size
    for size in (1, 2, 3, 7, 30, n):
        ranges = with_states([ByteRange(str(path), at, min(n, at + size), n) for at in range(0, n, size)], local)
        for depth in (1, 2, 4):
            rows = [r for batch in local(ranges, "values", depth) for r in batch.to_pylist()]
            same(rows, plain(doc, depth))


def test_several_documents_in_a_file_empty_files_and_broken_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": [1, 2], "b": {}}\n[[3], {"c": 4}, []]\n')
    assert sorted((r["keys"], r["value"]) for r in scan_json_values(spark, str(tmp_path / "a.json"), 2, 5).collect()) == [(["0", "0"], "3"), (["1", "c"], "4"), (["a", "0"], "1"), (["a", "1"], "2")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "e.json").write_text("")
    assert scan_json_values(spark, str(tmp_path / "e"), 1).count() == 0
    for i, text in enumerate(('{"a": [1}', '{"a": "x', "]")):
        (tmp_path / f"b{i}.json").write_text(text)
        with pytest.raises(ValueError):
            scan_json_values(spark, str(tmp_path / f"b{i}.json"), 1, 2)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    frames = {f"v{i}": {"frames": [f"{i}/{k}.png" for k in range(i % 5)]} for i in range(300)}
    (tmp_path / "n.json").write_text(json.dumps({"s": {"m_Real": {"all": frames}}}))
    assert len(byte_ranges(spark, str(tmp_path / "n.json"), 1000)) > 8
    rows = manifests.scan_nested_index(spark, str(tmp_path / "n.json"), 1000)
    assert rows.rdd.getNumPartitions() > 8
    assert sorted((r["video"], r["position"], r["frame"]) for r in rows.collect()) == sorted((v, k, f) for v, x in frames.items() for k, f in enumerate(x["frames"]))
    boxes = {"annotations": [{"image_id": i % 40, "category_id": i % 7, "note": "]}"} for i in range(200)], "info": "x", "images": [{"id": i, "file_name": f"{i}.png", "width": 9} for i in range(60)]}
    (tmp_path / "c.json").write_text(json.dumps(boxes))
    hit = {a["image_id"] for a in boxes["annotations"] if a["category_id"] == 1}
    assert {r["image_id"]: r["label"] for r in manifests.scan_annotations(spark, str(tmp_path / "c.json"), split_bytes=500).collect()} == {i: int(i in hit) for i in range(60)}


def test_many_ranges_take_few_tasks(tmp_path):
    """Before, every range was a task, and each task got the list of all of them."""
    listed = json.dumps([["file:///x", at, at + 10, 10_000, False, []] for at in range(0, 10_000, 10)])
    parts = JsonReader({"ranges": listed, "tasks": "8", "most": "5000"}, None).partitions()
    assert len(parts) == 8 and [r.start for p in parts for r in p.ranges] == list(range(0, 10_000, 10))
    assert len(JsonReader({"ranges": listed, "tasks": "8", "most": "500"}, None).partitions()) == 20


def test_large_groups_become_several_documents(spark, tmp_path, monkeypatch):
    """Before, one task sorted and wrote all of a group."""
    from tessera.sources import sinks

    monkeypatch.setattr(sinks, "DOCUMENT_ROWS", 50)
    rows = spark.range(400).selectExpr("IF(id % 4 = 0, 'a', 'b') AS by", "IF(id % 2 = 0, 'images', 'annotations') AS part", "id AS place", "CAST(id AS STRING) AS value")
    sinks.write_json_arrays(rows, str(tmp_path / "d"), "by")
    found = scan_json_values(spark, str(tmp_path / "d"), 2, 700).collect()
    assert sorted((r["keys"][0], int(r["value"])) for r in found) == sorted(("images" if i % 2 == 0 else "annotations", i) for i in range(400))
    assert sum(r["value"].startswith("{") for r in spark.read.text(str(tmp_path / "d")).collect()) >= 6
