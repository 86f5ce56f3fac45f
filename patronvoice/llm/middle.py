"""Fill-in-middle by displacement scatter.

A text is cut twice, and its prefix, middle and suffix change places behind
markers. Every byte of a batch moves by some number of places, and bytes of one
part move alike; so an array that holds only the changes of that number, at the
cuts, gives each byte its place by a running sum. One numpy scatter then builds
all texts of the batch, and the same sum over the parts found behind the markers
gathers them back. Cuts are counted in code points and looked up in bytes by
counting the first bytes of characters page by page.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronvoice.llm.common import fresh, other_columns, register, table

MARKERS = ("<P>", "<S>", "<M>")
#: Percent of the texts that are moved, and percent of those that start with the suffix.
RATE, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
#: Texts and bytes that are moved at once; a longer text is moved alone, block by block.
_TEXTS, _BYTES, _BLOCK, _PAGE = 1024, 4 << 20, 1 << 20, 1024


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and where each text starts, with the end of the last."""
    texts = pa.array(texts).cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if starts else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def _texts_of(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _slices(starts: np.ndarray):
    """Ranges of consecutive texts of bounded number and size; a longer text is a range of its own."""
    at, n = 0, len(starts) - 1
    while at < n:
        to = int(np.searchsorted(starts, starts[at] + _BYTES, side="right")) - 1
        to = min(max(to, at + 1), at + _TEXTS, n)
        yield at, to
        at = to


def byte_places(data: np.ndarray, starts: np.ndarray, points: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Where in the bytes each text's code points of the given numbers start; the number behind the last is the text's end."""
    first = np.zeros(-(-(len(data) + 1) // _PAGE) * _PAGE, dtype=np.uint8)
    first[: len(data)] = (data & 0xC0) != 0x80
    pages = first.reshape(-1, _PAGE)
    sums = pages.sum(axis=1, dtype=np.int64)
    before = np.cumsum(sums) - sums
    # code points before each text: whole pages, then the rest of the page that it starts in
    page, rest = starts // _PAGE, starts % _PAGE
    ahead = before[page] + [int(np.count_nonzero(pages[p, :r])) for p, r in zip(page.tolist(), rest.tolist())]
    found = []
    for numbers in points:
        goal = ahead[:-1] + numbers
        own = np.maximum(np.searchsorted(before, goal, side="right") - 1, 0)
        inside = np.cumsum(pages[own], axis=1, dtype=np.int16) > (goal - before[own])[:, None]
        place = own * _PAGE + inside.argmax(axis=1)
        found.append(np.where(goal >= ahead[1:], starts[1:], place))
    return found


def _moved(data: np.ndarray, edges: np.ndarray, shifts: np.ndarray, size: int, gather: bool = False, out: np.ndarray | None = None) -> np.ndarray:
    """Bytes moved by the shift of the part that they are in; ``edges`` are the starts of the parts, in order.

    A scatter reads in order and writes to the shifted place; a gather writes in
    order and reads from it. The running sum of the changes goes on from block to
    block, so a text of any length needs the same room.
    """
    out = np.zeros(size, dtype=np.uint8) if out is None else out
    change = np.diff(shifts, prepend=0)
    total, carry = size if gather else len(data), 0
    for low in range(0, total, _BLOCK):
        high = min(low + _BLOCK, total)
        a, b = np.searchsorted(edges, (low, high), side="left")
        steps = np.zeros(high - low, dtype=np.int64)
        np.add.at(steps, edges[a:b] - low, change[a:b])
        steps[0] += carry
        shift = np.cumsum(steps)
        carry = int(shift[-1])
        shift += np.arange(low, high)
        if gather:
            out[low:high] = data[shift]
        else:
            out[shift] = data[low:high]
    return out


def _put(out: np.ndarray, places: np.ndarray, marker: bytes) -> None:
    for i, byte in enumerate(marker):
        out[places + i] = byte


def scatter_texts(texts: pa.Array, low: np.ndarray, high: np.ndarray, form: np.ndarray, markers: Sequence[str] = MARKERS) -> pa.Array:
    """Each text with its parts in the order of its form; the middle is from code point ``low`` to ``high``."""
    p, s, m = (x.encode() for x in markers)
    data, starts = _bytes_of(texts)
    pieces = []
    for at, to in _slices(starts):
        own = starts[at : to + 1] - starts[at]
        raw, kind = data[starts[at] : starts[to]], form[at:to]
        a, b = byte_places(raw, own, [low[at:to], high[at:to]])
        before, inside, after = a - own[:-1], b - a, own[1:] - b
        moved, turned = kind != PLAIN, kind == SPM
        size = own[1:] - own[:-1] + np.where(moved, len(p) + len(s) + len(m), 0)
        ends = np.cumsum(size)
        begin = ends - size
        first_p = begin + np.where(turned, len(s) + after, 0)  # where the prefix's marker goes
        first_s = begin + np.where(turned, 0, len(p) + before)
        first_m = ends - inside - len(m)
        to_prefix = np.where(moved, first_p + len(p), begin)
        to_middle = np.where(moved, first_m + len(m), begin + before)
        to_suffix = np.where(moved, first_s + len(s), begin + before + inside)
        edges = np.stack([own[:-1], a, b], axis=1).ravel()
        shifts = np.stack([to_prefix, to_middle, to_suffix], axis=1).ravel() - edges
        out = np.zeros(int(ends[-1]), dtype=np.uint8)
        for places, marker in ((first_p, p), (first_s, s), (first_m, m)):
            _put(out, places[moved], marker)
        _moved(raw, edges, shifts, len(out), out=out)
        pieces.append(_texts_of(out, np.append(0, ends)))
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())


def gather_texts(texts: pa.Array, form: np.ndarray, markers: Sequence[str] = MARKERS) -> pa.Array:
    """The texts before ``scatter_texts``, from its output and the forms alone."""
    p, s, m = (x.encode() for x in markers)
    data, starts = _bytes_of(texts)
    pieces = []
    for at, to in _slices(starts):
        own = starts[at : to + 1] - starts[at]
        raw, kind = data[starts[at] : starts[to]], form[at:to]
        moved, turned = kind != PLAIN, kind == SPM
        place = [_first(raw, own[:-1], marker) for marker in (p, s, m)]
        end = own[1:]
        # a part runs from its marker to the next one, or to the text's end
        from_p, from_s, from_m = place[0] + len(p), place[1] + len(s), place[2] + len(m)
        before = np.where(moved, np.where(turned, place[2], place[1]) - from_p, 0)
        after = np.where(moved, np.where(turned, place[0], place[2]) - from_s, 0)
        inside = np.where(moved, end - from_m, end - own[:-1])
        size = before + inside + after
        ends = np.cumsum(size)
        begin = ends - size
        edges = np.stack([begin, begin + before, begin + before + inside], axis=1).ravel()
        source = np.stack([from_p, np.where(moved, from_m, own[:-1]), from_s], axis=1)
        shifts = np.where(moved[:, None], source, own[:-1, None] - np.stack([0 * before, 0 * before, -inside], axis=1)).ravel() - edges
        pieces.append(_texts_of(_moved(raw, edges, shifts, int(ends[-1]), gather=True), np.append(0, ends)))
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())


def _first(raw: np.ndarray, starts: np.ndarray, marker: bytes) -> np.ndarray:
    """Where the marker is found first from each start on; 0 where it is not."""
    hit = np.flatnonzero(raw[: max(0, len(raw) - len(marker) + 1)] == marker[0])
    for i in range(1, len(marker)):
        hit = hit[raw[hit + i] == marker[i]]
    if not len(hit):
        return np.zeros(len(starts), dtype=np.int64)
    at = np.searchsorted(hit, starts)
    return np.where(at < len(hit), hit[np.minimum(at, len(hit) - 1)], 0)


def _form_number(form: Column) -> Column:
    return F.when(form == FORMS[PSM], F.lit(PSM)).when(form == FORMS[SPM], F.lit(SPM)).otherwise(F.lit(PLAIN)).cast("long")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "1",
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    markers: Sequence[str] = MARKERS,
) -> DataFrame:
    """``docs`` with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The cuts and the form follow from the SHA-256 of ``seed:id``, so a repeated
    task gives the same rows and rows of one id are cut by the same numbers; a null
    id counts as an empty one. A null text is the empty text, which is plain, as is
    any text that holds a marker; plain rows have null lengths. Texts of any length
    are moved whole. Columns named like the new ones are replaced; an empty table
    stays empty. A narrow job without a shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    n = F.char_length(text).cast("bigint")
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    plain = (n == 0) | (h[2] % 100 >= rate)
    for marker in markers:
        plain = plain | text.contains(marker)
    form = F.when(plain, FORMS[PLAIN]).when(h[3] % 100 < suffix_first, FORMS[SPM]).otherwise(FORMS[PSM])

    @F.arrow_udf("string")
    def move(texts: pa.Array, low: pa.Array, high: pa.Array, kind: pa.Array) -> pa.Array:
        return scatter_texts(texts, *(c.to_numpy(zero_copy_only=False) for c in (low, high, kind)), markers)

    keep = other_columns(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    low, high = fresh("_low", docs), fresh("_high", docs)
    cut = docs.select(
        *[F.col(f"`{f.name}`") for f in keep],
        text.alias(fresh("_text", docs)),
        n.alias("n"),
        form.alias("form"),
        F.least(first, second).alias(low),
        F.greatest(first, second).alias(high),
    )
    moved = F.col("form") != FORMS[PLAIN]
    return cut.select(
        *[F.col(f"`{f.name}`") for f in keep],
        "n",
        "form",
        F.when(moved, F.col(low)).alias("prefix_chars"),
        F.when(moved, F.col(high) - F.col(low)).alias("middle_chars"),
        move(F.col(fresh("_text", docs)), F.col(low), F.col(high), _form_number(F.col("form"))).alias("output"),
    )


def restore_middle(
    df: DataFrame, output_col: str = "output", form_col: str = "form", out_col: str = "restored", markers: Sequence[str] = MARKERS
) -> DataFrame:
    """``df`` with the text that an output of ``fill_in_middle`` was made from; null is the empty text, a null form is plain."""

    @F.arrow_udf("string")
    def back(texts: pa.Array, kind: pa.Array) -> pa.Array:
        return gather_texts(texts, kind.to_numpy(zero_copy_only=False), markers)

    keep = other_columns(df, out_col)
    text = F.coalesce(F.col(output_col), F.lit(""))
    return df.select(*[F.col(f"`{f.name}`") for f in keep], back(text, _form_number(F.col(form_col))).alias(out_col))


_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents),
h AS (SELECT *, ('0x' || d[1:8])::BIGINT % (n + 1) AS c1, ('0x' || d[9:16])::BIGINT % (n + 1) AS c2,
  ('0x' || d[17:24])::BIGINT % 100 AS h3, ('0x' || d[25:32])::BIGINT % 100 AS h4 FROM t),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE
  WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
  WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


@register("op13_displacement_scatter", _SQL)
def op13(spark, folder):
    moved = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    back = restore_middle(moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
    return back.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
