"""Deeply nested records to flat tables, by Arrow list offsets and parent indices.

A list column is flattened without touching its rows: the offsets give each child its parent index, keys are
propagated by `take`, ordinals are the child's index less the index of its parent's first child.
JSON payloads of varying layout are decoded once, then flattened level by level in the same manner: each
level is a list of objects with a parent index; subtree sizes, summed upwards, give every node its number in
written order without recursion.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Keys of the flat tables: where a record came from and its id, the page's place in it, the element's number on the page.
NODE_COLUMNS = (
    "origin string, rec_id bigint, page_pos int, page_number int, node_no int, parent_no int, depth int, label string, text string, "
    "reading_order int, confidence double, figure_path string, context_text string"
)
BOX_COLUMNS = "origin string, rec_id bigint, page_pos int, page_number int, node_no int, kind string, x0 double, y0 double, x1 double, y1 double"
PAGE_COLUMNS = "origin string, rec_id bigint, page_pos int, page_number int, n_nodes int"
FOUND_COLUMNS = "origin string, rec_id bigint, page_pos int, page_number int, node_no int, parent_no int"
RECORD_COLUMNS = "origin string, rec_id bigint, source string, source_file string, n_pages int, complete boolean"


def child_index(array: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Parent index, child values and ordinal (from 1) of every non-null child of a list array."""
    parent = pc.list_parent_indices(array).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(array)
    there = values.is_valid().to_numpy(zero_copy_only=False)
    parent = parent[there]
    values = values.filter(pa.array(there))
    n = len(parent)
    first = np.concatenate(([True], parent[1:] != parent[:-1])) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, int)
    return parent, values, np.arange(n) - start + 1


def field(struct: pa.StructArray, name: str, kind: pa.DataType) -> pa.Array:
    """A struct's field, or nulls where the struct has no such field."""
    at = struct.type.get_field_index(name)
    return pc.struct_field(struct, name) if at >= 0 else pa.nulls(len(struct), kind)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(name)
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def box_columns(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose box has a number, and its first four numbers by position; those a short box lacks are NaN."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size > 0)
    kept = lists.take(pa.array(rows))
    flat = pc.list_flatten(kept).to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(size[rows])[:-1])).astype(int) if len(rows) else np.zeros(0, int)
    return rows, [np.where(size[rows] > k, flat[np.minimum(start + k, max(len(flat) - 1, 0))], np.nan) if len(rows) else np.zeros(0) for k in range(4)]


class Nodes:
    """Flat element rows of one batch, as Arrow arrays by column."""

    def __init__(self, record: np.ndarray, page_pos: np.ndarray, page_number: pa.Array, node: np.ndarray, parent: np.ndarray, depth: np.ndarray, values: dict[str, pa.Array], boxes: list[tuple[str, np.ndarray, list[np.ndarray]]]):
        self.record, self.page_pos, self.page_number, self.node, self.parent, self.depth, self.values, self.boxes = record, page_pos, page_number, node, parent, depth, values, boxes


def nodes_of_lists(batch: pa.RecordBatch) -> tuple[Nodes, dict[str, pa.Array]]:
    """Elements of typed records: two list levels, no element inside another. Also the page table's arrays."""
    pages = column(batch, "pages")
    page_parent, page, page_ord = child_index(pages)
    elements = field(page, "elements", pa.list_(pa.struct([("label", pa.string())])))
    owner, element, ordinal = child_index(elements)
    number = field(page, "page_number", pa.int32())
    boxes = []
    for kind in ("bbox", "padded_bbox"):
        lists = field(element, kind, pa.list_(pa.float64()))
        boxes.append((kind, *box_columns(lists)))
    kinds = {"label": pa.string(), "text": pa.string(), "reading_order": pa.int32(), "confidence": pa.float64(), "figure_path": pa.string(), "context_text": pa.string()}
    values = {k: field(element, k, t) for k, t in kinds.items()}
    nodes = Nodes(page_parent[owner], page_ord[owner], number.take(pa.array(owner)), ordinal, np.zeros(len(owner), int), np.ones(len(owner), int), values, boxes)
    count = np.bincount(owner, minlength=len(page)) if len(page) else np.zeros(0, int)
    return nodes, {"record": page_parent, "page_pos": page_ord, "page_number": number, "n_nodes": count}


def whole(value) -> int | None:
    """An integer given as a number or as a string, else null."""
    try:
        return None if value is None or isinstance(value, bool) else int(float(value))
    except (TypeError, ValueError, OverflowError):
        return None


def number(value) -> float | None:
    try:
        return None if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None


def opened(value):
    """A value that holds JSON as a string is opened; a string that isn't JSON counts as nothing."""
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return None
    return value


def find_pages(value):
    """The value of the outermost key `pages`, whatever objects and lists lie around it."""
    level = [value]
    while level:
        below = []
        for x in level:
            x = opened(x) if isinstance(x, str) and x[:1] in "[{" else x
            if isinstance(x, dict):
                if "pages" in x:
                    return x["pages"], x.get("source_file")
                below += x.values()
            elif isinstance(x, list):
                below += x
        level = below
    return None, None


def as_list(value, child: bool) -> list:
    """Children held as a list, as one object, or as an object of numbered objects."""
    value = opened(value)
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        if not value or (child and not all(k.strip().isdigit() for k in value)):
            return [value] if value else []
        return list(value.values())
    return []


def as_pages(value) -> list[tuple[int | None, object]]:
    """(page number, elements) of each page object; a page without its own number takes its key."""
    value = opened(value)
    if isinstance(value, dict):
        pairs = [(None, value)] if "elements" in value else [(k, v) for k, v in value.items()]
    else:
        pairs = [(None, v) for v in value] if isinstance(value, list) else []
    got = []
    for key, page in pairs:
        page = opened(page)
        if isinstance(page, dict):
            own = whole(page.get("page_number"))
            got.append((whole(key) if own is None else own, page.get("elements")))
        elif isinstance(page, list):
            got.append((whole(key), page))
    return got


def read_box(value) -> list[tuple[str, list[float]]]:
    """Boxes in any of the spellings met: four numbers, a string of four, named corners, or one list per unit."""
    value = opened(value) if isinstance(value, str) and value[:1] in "[{" else value
    if isinstance(value, str):
        value = value.replace(",", " ").split()
    if isinstance(value, dict):
        low = {str(k).lower(): v for k, v in value.items()}
        for names in (("x0", "y0", "x1", "y1"), ("x_min", "y_min", "x_max", "y_max"), ("left", "top", "right", "bottom")):
            if all(n in low for n in names):
                value = [low[n] for n in names]
                break
        else:
            return [(f"bbox_{k}", b) for k, v in low.items() for _, b in read_box(v)]
    if isinstance(value, list) and value:
        four = [number(v) for v in value[:4]]
        if any(v is not None for v in four):
            return [("bbox", [np.nan if v is None else v for v in four] + [np.nan] * (4 - len(four)))]
    return []


def nodes_of_payloads(payloads: list[str | None]) -> tuple[Nodes, dict[str, object], list[bool], list[str | None], list[int]]:
    """Elements of JSON payloads, level by level; payloads that aren't complete JSON give nothing."""
    complete, files, n_pages = [], [], []
    page_record, page_pos, page_number, level, owner = [], [], [], [], []
    for i, payload in enumerate(payloads):
        try:
            document = json.loads(payload) if payload is not None else None
            complete.append(payload is not None)
        except ValueError:
            document = None
            complete.append(False)
        pages, name = find_pages(document) if document is not None else (None, None)
        files.append(name if isinstance(name, str) else None)
        pages = as_pages(pages)
        n_pages.append(len(pages))
        for k, (page, elements) in enumerate(pages):
            page_record.append(i)
            page_pos.append(k + 1)
            page_number.append(page)
            level.append(elements)
            owner.append(len(page_record) - 1)
    levels: list[tuple[np.ndarray, list[dict]]] = []
    holder = np.arange(len(level))
    while len(level):
        lists = [[x for x in map(opened, as_list(v, True)) if isinstance(x, dict)] for v in level]
        parent = holder[np.repeat(np.arange(len(level)), [len(x) for x in lists])] if lists else np.zeros(0, int)
        objects = [x for own in lists for x in own]
        if not objects:
            break
        levels.append((parent, objects))
        holder = np.flatnonzero([x.get("elements") is not None for x in objects])
        level = [objects[j]["elements"] for j in holder]
    size = [np.ones(len(o), int) for _, o in levels]
    for d in range(len(levels) - 1, 0, -1):
        np.add.at(size[d - 1], levels[d][0], size[d])
    parts = []
    up_page, up_node = np.arange(len(page_record)), np.zeros(len(page_record), int)
    for d, (parent, objects) in enumerate(levels):
        before = np.cumsum(size[d]) - size[d]
        first = np.searchsorted(parent, np.arange(len(up_page)))
        base = before[np.minimum(first, len(before) - 1)]
        node = up_node[parent] + 1 + before - base[parent]
        parts.append((up_page[parent], node, up_node[parent], np.full(len(node), d + 1), objects))
        up_page, up_node = up_page[parent], node
    page = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, int)
    node = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, int)
    above = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, int)
    depth = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, int)
    objects = [x for p in parts for x in p[4]]
    text = lambda k: pa.array([x[k] if isinstance(x.get(k), str) else None if x.get(k) is None else json.dumps(x[k]) for x in objects], pa.string())
    values = {k: text(k) for k in ("label", "text", "figure_path", "context_text")}
    values["reading_order"] = pa.array([whole(x.get("reading_order")) for x in objects], pa.int32())
    values["confidence"] = pa.array([number(x.get("confidence")) for x in objects], pa.float64())
    kinds: dict[str, tuple[list[int], list[list[float]]]] = {}
    for j, x in enumerate(objects):
        for prefix in ("bbox", "padded_bbox"):
            for kind, box in read_box(x.get(prefix)) if x.get(prefix) is not None else ():
                rows, four = kinds.setdefault(kind.replace("bbox", prefix, 1), ([], []))
                rows.append(j)
                four.append(box)
    boxes = [(k, np.array(rows, int), list(np.array(four, float).reshape(-1, 4).T)) for k, (rows, four) in kinds.items()]
    record, pos = np.array(page_record, int), np.array(page_pos, int)
    numbers = pa.array(page_number, pa.int32())
    nodes = Nodes(record[page], pos[page], numbers.take(pa.array(page)), node, above, depth, values, boxes)
    return nodes, {"record": record, "page_pos": pos, "page_number": numbers, "n_nodes": np.bincount(page, minlength=len(record))}, complete, files, n_pages


def emit(part: str, origin: str, keys: pa.Array, nodes: Nodes, pages: dict) -> list[pa.RecordBatch]:
    named = lambda n: {"origin": pa.repeat(pa.scalar(origin, pa.string()), n)}
    i32 = lambda x: pa.array(np.asarray(x), pa.int32())
    if part == "pages":
        return [pa.record_batch({**named(len(pages["record"])), "rec_id": keys.take(pa.array(pages["record"])), "page_pos": i32(pages["page_pos"]), "page_number": pages["page_number"].cast(pa.int32()), "n_nodes": i32(pages["n_nodes"])})]
    ids = keys.take(pa.array(nodes.record))
    number_ = nodes.page_number.cast(pa.int32())
    if part == "found":
        return [pa.record_batch({**named(len(ids)), "rec_id": ids, "page_pos": i32(nodes.page_pos), "page_number": number_, "node_no": i32(nodes.node), "parent_no": i32(nodes.parent)})]
    if part == "elements":
        v = nodes.values
        return [pa.record_batch({**named(len(ids)), "rec_id": ids, "page_pos": i32(nodes.page_pos), "page_number": number_, "node_no": i32(nodes.node), "parent_no": i32(nodes.parent), "depth": i32(nodes.depth), "label": v["label"].cast(pa.string()), "text": v["text"].cast(pa.string()), "reading_order": v["reading_order"].cast(pa.int32()), "confidence": v["confidence"].cast(pa.float64()), "figure_path": v["figure_path"].cast(pa.string()), "context_text": v["context_text"].cast(pa.string())})]
    out = []
    for kind, rows, four in nodes.boxes:
        at = pa.array(rows)
        out.append(pa.record_batch({**named(len(rows)), "rec_id": ids.take(at), "page_pos": i32(nodes.page_pos[rows]), "page_number": number_.take(at), "node_no": i32(nodes.node[rows]), "kind": pa.array([kind] * len(rows), pa.string()), **{n: pa.array(x, pa.float64(), from_pandas=True) for n, x in zip(("x0", "y0", "x1", "y1"), four)}}))
    return out


SCHEMAS = {"found": FOUND_COLUMNS, "elements": NODE_COLUMNS, "pages": PAGE_COLUMNS, "boxes": BOX_COLUMNS, "records": RECORD_COLUMNS}
KEYS = {"records": ["origin", "rec_id"], "pages": ["origin", "rec_id", "page_pos"], "elements": ["origin", "rec_id", "page_pos", "node_no"], "boxes": ["origin", "rec_id", "page_pos", "node_no", "kind"]}
KEYS["found"] = KEYS["elements"]


def flatten_lists(records: DataFrame, part: str) -> DataFrame:
    """A flat table (`part`: records, pages, elements, boxes, found) of typed nested records with rec_id and pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "rec_id")
            if part == "records":
                n = len(batch)
                size = pc.list_value_length(column(batch, "pages"))
                yield pa.record_batch({"origin": pa.array(["typed"] * n, pa.string()), "rec_id": keys, "source": column(batch, "source").cast(pa.string()), "source_file": column(batch, "source_file").cast(pa.string()), "n_pages": pc.fill_null(size, 0).cast(pa.int32()), "complete": pa.array([True] * n)})
                continue
            yield from emit(part, "typed", keys, *nodes_of_lists(batch))

    return records.mapInArrow(run, SCHEMAS[part])


def flatten_payloads(raw: DataFrame, part: str) -> DataFrame:
    """The same flat tables of JSON payloads (columns rec_id, source_file, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 500):
                batch = whole_batch.slice(at, 500)
                keys = column(batch, "rec_id")
                nodes, pages, complete, files, n_pages = nodes_of_payloads(column(batch, "payload").to_pylist())
                if part == "records":
                    own = column(batch, "source_file").to_pylist()
                    yield pa.record_batch({"origin": pa.array(["payload"] * len(batch), pa.string()), "rec_id": keys, "source": pa.nulls(len(batch), pa.string()), "source_file": pa.array([a if a is not None else b for a, b in zip(own, files)], pa.string()), "n_pages": pa.array(n_pages, pa.int32()), "complete": pa.array(complete)})
                    continue
                yield from emit(part, "payload", keys, nodes, pages)

    return raw.mapInArrow(run, SCHEMAS[part])


def flat_table(records: DataFrame, raw: DataFrame, part: str) -> DataFrame:
    """One flat table of both inputs.

    Rows delivered twice (equal rec_id in one input) count once, and rows without a rec_id count as one record; equal ids of
    both inputs are two records, and pages with equal or no numbers are kept apart by their place. The copies are dropped on the narrow keys of the flat rows,
    never on the nested ones. Null pages, null elements and incomplete payloads give no row in pages, elements
    and boxes; such a record keeps its row in `records`. Empty inputs give empty tables; extra columns are ignored.
    """
    head = ["source", "source_file"] if part == "records" else []
    raw_head = ["source_file"] if part == "records" else []
    both = flatten_lists(records.select("rec_id", *head, "pages"), part).unionByName(flatten_payloads(raw.select("rec_id", *raw_head, "payload"), part))
    flat = both.dropDuplicates(KEYS[part])
    return flat.select("rec_id", "page_number", "node_no", "parent_no") if part == "found" else flat
