"""JSON objects from files that are read in parts, against a decoder that reads each file as a whole."""

import json
import random

import pytest

from seamline.sources import maps, objects, otlp  # noqa: F401


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "800")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain(text):
    decoder, at, out = json.JSONDecoder(), 0, []
    while at < len(text):
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            at = at + 1 if text[at].isspace() else text.find("\n", at) + 1 or len(text)
            continue
        out += [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
    return sorted(json.dumps(x, sort_keys=True) for x in out)


def made(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return [rng.randrange(1000), "".join(rng.choice('ab}{][",:\\ é\n\t') for _ in range(rng.randrange(30))), rng.choice([None, True, 0.5])][kind]
    if kind == 3:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": made(rng, depth + 1) for i in range(rng.randrange(4))}


def read(spark, path):
    return sorted(json.dumps(json.loads(r["value"]), sort_keys=True) for r in maps.json_texts(spark, path).collect())


def test_layouts_in_small_parts(spark, tmp_path, small_parts):
    rng = random.Random(3)
    rows = [{f"r{k}": made(rng) for k in range(rng.randrange(1, 4))} for _ in range(36)]
    forms = {
        "array": json.dumps(rows, ensure_ascii=False), "pretty": json.dumps(rows, indent=2), "apart": "\n\n".join(json.dumps(r, indent=1, ensure_ascii=False) for r in rows), "run": "".join(json.dumps(r) for r in rows),
        "mixed": json.dumps(rows[:12]) + "\n" + json.dumps(rows[12:24]) + " " + " ".join(map(json.dumps, rows[24:])), "nested": json.dumps([rows[:3], rows[3:5], rows[5], 7, "x}"]) + json.dumps({"end": 1}),
    }
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        assert spark.read.option("lineSep", "}").text(str(tmp_path / name)).rdd.getNumPartitions() > (2 if name != "nested" else 0)
        assert read(spark, str(tmp_path / name)) == plain(text), name
    assert read(spark, str(tmp_path)) == sorted(x for text in forms.values() for x in plain(text))


@pytest.mark.parametrize("text", [
    '{"x": 1}\nbroken {\n{"x": 2}', '{"x": 1', '{"x": 1} {"y": ', "[", "", "no json\nat all", 'a " quote\n{"x": 1}\nand } some ]\n[{"x": 2}]', '{"a": "\\\\"}{"b": "\\""} "{" {"c": 3}', '[{"a": 1}, {"b": 2}', '5 {"x": "}"}', '{"a": 1}}} {"b": 2}',
])
def test_broken_files(spark, tmp_path, text):
    (tmp_path / "f").write_text(text)
    got, want = read(spark, str(tmp_path / "f")), plain(text)
    # What the decoder gives up with its line, brackets may still find.
    assert set(want) <= set(got) and all(json.loads(x) for x in got)


def test_one_line_is_many_tasks(spark, tmp_path):
    """An array of one line: its bytes are dealt out, and the largest task reads a small part."""
    row = json.dumps({"id": 0, "text": "y" * 300, "list": [{"a": 1}] * 5})
    (tmp_path / "f").write_text("[" + ",".join([row] * 4000) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        cut = maps.json_texts(spark, str(tmp_path / "f"))
        assert cut.count() == 4000
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "f")).rdd.getNumPartitions() >= 14
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
