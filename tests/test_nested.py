import json

from foliospark.operators import nested
from foliospark.sources.tables import recognition_schema


def walk(elements, parent, out, counter):
    """Plain recursion: the numbering by definition."""
    elements = [elements] if isinstance(elements, dict) else elements or []
    for e in elements:
        if e is None:
            continue
        counter[0] += 1
        own = counter[0]
        out.append((own, parent, e.get("text")))
        walk(e.get("elements"), own, out, counter)


def expected(pages):
    rows = []
    for number, elements in pages:
        out = []
        walk(elements, 0, out, [0])
        rows += [(number, *r) for r in out]
    return sorted(rows, key=str)


TREE = [{"text": "a", "elements": [{"text": "b"}, None, {"text": "c", "elements": {"text": "d"}}]}, None, {"text": "e"}, {"text": "f", "elements": [{"text": "g"}]}]
LAYOUTS = [
    {"source_file": "x", "pages": [{"page_number": 1, "elements": TREE}, {"page_number": "2", "elements": None}]},
    {"pages": {"1": {"elements": TREE}, "2": {"elements": []}}},
    [{"pages": [{"page_number": "1", "elements": TREE}]}],
    {"meta": {"source_file": "x"}, "result": {"layout": {"pages": [{"page_number": 1, "elements": TREE}]}}},
    {"pages": json.dumps([{"page_number": 1, "elements": TREE}])},
]


def test_payload_layouts(spark):
    payloads = [json.dumps(x) for x in LAYOUTS] + [None, "", '{"pages": [', json.dumps({"pages": None}), "[]", "3"]
    raw = spark.createDataFrame([(i, None, p, "clash") for i, p in enumerate(payloads)], "rec_id bigint, source_file string, payload string, node_no string")
    got = nested.flatten_payloads(raw.select("rec_id", "source_file", "payload"), "elements").collect()
    for i in range(len(LAYOUTS)):
        assert sorted([(r.page_number, r.node_no, r.parent_no, r.text) for r in got if r.rec_id == i], key=str) == expected([(1, TREE)])
    assert all(r.rec_id < len(LAYOUTS) for r in got)
    records = nested.flatten_payloads(raw.select("rec_id", "source_file", "payload"), "records").collect()
    assert [r.complete for r in sorted(records)][len(LAYOUTS):] == [False, False, False, True, True, True]


def test_boxes(spark):
    boxes = [[1, 2, 3, 4], "1 2 3 4", {"x0": 1, "y0": 2, "x1": "3", "y1": 4}, {"px": [1, 2, 3, 4], "pt": [0.5, 1, 1.5, 2]}, [], None, [1, 2], "n/a"]
    raw = spark.createDataFrame([(1, json.dumps({"pages": [{"page_number": 1, "elements": [{"bbox": b} for b in boxes]}]}))], "rec_id bigint, payload string")
    got = sorted((r.node_no, r.kind, r.x0, r.y0, r.x1, r.y1) for r in nested.flatten_payloads(raw, "boxes").where("x1 is not null").collect())
    assert got == [(1, "bbox", 1, 2, 3, 4), (2, "bbox", 1, 2, 3, 4), (3, "bbox", 1, 2, 3, 4), (4, "bbox_pt", 0.5, 1, 1.5, 2), (4, "bbox_px", 1, 2, 3, 4)]


def test_typed_records(spark):
    schema = recognition_schema()
    el = lambda **k: tuple({"label": None, "text": None, "bbox": None, "padded_bbox": None, "reading_order": None, "figure_path": None, "confidence": None, "page_number": None, "context_text": None, **k}.values())
    rows = [
        (1, "s", "f", None, [(2, [el(text="b", bbox=[1.0, 2.0, 3.0, 4.0]), None, el(text="c", bbox=[5.0])]), (1, [el(text="a")]), (3, None), (4, []), (5, [None])]),
        (2, None, None, None, None),
        (3, None, None, None, []),
        (None, None, None, None, [(1, [el()])]),
    ]
    df = spark.createDataFrame(rows + rows[:1], schema)
    raw = spark.createDataFrame([], "rec_id bigint, source_file string, payload string")
    got = nested.flat_table(df, raw, "elements").collect()
    assert sorted(((r.rec_id or 0), r.page_number, r.node_no, r.parent_no, r.text or "") for r in got) == [(0, 1, 1, 0, ""), (1, 1, 1, 0, "a"), (1, 2, 1, 0, "b"), (1, 2, 2, 0, "c")]
    assert nested.flat_table(df, raw, "records").count() == 4
    assert sorted((r.page_number, r.n_nodes) for r in nested.flat_table(df, raw, "pages").where("rec_id = 1").collect()) == [(1, 1), (2, 2), (3, 0), (4, 0), (5, 0)]
    boxes = nested.flat_table(df, raw, "boxes").collect()
    assert sorted((r.node_no, r.x0, r.y1) for r in boxes if r.y1 is not None) == [(1, 1.0, 4.0)] and len(boxes) == 2
    assert nested.flat_table(df.limit(0), raw, "found").count() == 0


def test_equal_numbers_and_ids(spark):
    """Pages without a number, and equal ids of both inputs, lose nothing."""
    pages = [{"page_number": None, "elements": [{"text": "a", "bbox": [1, 2, 3, 4]}]}, {"elements": [{"text": "b", "bbox": [5, 6, 7, 8]}]}]
    raw = spark.createDataFrame([(1, None, json.dumps({"pages": pages})), (1, None, json.dumps({"pages": pages}))], "rec_id bigint, source_file string, payload string")
    typed = spark.createDataFrame([(1, None, None, None, [(None, [("para", "c", [1.0], None, None, None, None, None, None)])])], recognition_schema())
    for part, n in (("found", 3), ("elements", 3), ("boxes", 3), ("pages", 3), ("records", 2)):
        assert nested.flat_table(typed, raw, part).count() == n, part
    assert nested.flat_table(typed, raw, "found").columns == ["rec_id", "page_number", "node_no", "parent_no"]
