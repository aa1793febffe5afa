"""Linked data as variants against Python's own walk over the same JSON."""

import json

from pyspark.sql import functions as F

from brickyard.operators import linked_data


def walk(x):
    """Objects, outer ones first, those of an object by the names of its fields."""
    if isinstance(x, dict):
        yield x
    for y in [x[k] for k in sorted(x)] if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from walk(y)


def said(v, inner):
    if isinstance(v, list):
        return [str(x) for x in v]
    if isinstance(v, dict):
        return [str(v[inner])] if inner in v else []
    return [] if v is None else [str(v)]


DATA = [
    ['{"telephone": "0671234567", "b": {"telephone": ["0501112233", 380671234567]}, "a": [{"telephone": "x"}, {"telephone": "067 999 88 77"}]}'],
    ["no json", '[{"telephone": 1}, [[{"telephone": "2", "image": {"url": "u", "telephone": "3"}}]]]', '{"image": "i"}'],
    [], ["{}"], ["null", "5", '"text"'], ['{"telephone": null, "image": []}'], ['{"Telephone": "no", "image": {"link": "x"}}'],
    ['{"x":' * 60 + '{"telephone": "deep"}' + "}" * 60],
]


def test_fields_at_any_depth(spark):
    rows = spark.createDataFrame(list(enumerate(DATA)), "k int, scripts array<string>").repartition(3)
    found = linked_data.objects(rows, "k")
    for field, inner in (("telephone", None), ("image", "url")):
        got = {r.k: r["values"] for r in linked_data.values_of(found, "k", field, inner).collect() if r["values"]}
        want = {}
        for k, scripts in enumerate(DATA):
            for text in scripts:
                try:
                    want.setdefault(k, []).extend(t for o in walk(json.loads(text)) if field in o for t in said(o[field], inner))
                except ValueError:
                    continue
        assert got == {k: v for k, v in want.items() if v}, field
    assert linked_data.objects(rows.limit(0), "k").collect() == []


def test_scripts_and_phones_of_pages(spark):
    script = '<script type="application/ld+json">{}</script>'
    pages = [(1, script.format(DATA[0][0]) + "<p>x</p>" + script.format("{")), (2, None), (3, "<p>ld+json</p>"), (4, "<script>{}</script>")]
    rows = spark.createDataFrame(pages, "k int, html string")
    assert [r.n for r in rows.select(F.size(linked_data.linked_scripts(F.col("html"))).alias("n")).collect()] == [2, 0, 0, 0]
    assert [tuple(r) for r in linked_data.linked_phones(rows, "k").collect()] == [(1, ["+380671234567", "+380679998877", "+380501112233"])]
