"""Fill-in-middle: a text is cut in prefix, middle and suffix between its units, and the middle is moved to the end.

The tokenizers library's Split pre-tokenizer, with each match of the pattern isolated, gives the units and their
code-point offsets; nothing is trained. A text goes to it in blocks that end between two units, as the number of offsets
of each block is all that is needed until the ranks of the two cuts are known; the blocks that hold these are split again.

Edge cases: a null text is the empty text, which stays plain, as do texts that contain a sentinel; a null id has no digits
in what is hashed; repeated rows are cut alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents

UNIT = "[A-Za-z]+|[^A-Za-z]"
BLOCK = 200  # code points given to the library at once, about
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are cut, and of a hundred of these so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
_INSIDE = re.compile("[A-Za-z]*")


@functools.cache
def _split():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(UNIT), "isolated").pre_tokenize_str


def blocks(text: str, size: int = BLOCK) -> list[int]:
    """Starts of parts of about ``size`` code points, none inside a unit, and the end."""
    out, at, n = [0], size, len(text)
    while at < n:
        if text[at - 1].isascii() and text[at - 1].isalpha():
            at = _INSIDE.match(text, at).end()
        if at < n:
            out.append(at)
        at += size
    return [*out, n]


class Units:
    """The units of a text: their number and the offset of each."""

    def __init__(self, text: str, size: int = BLOCK):
        self.text, self.starts, self.split = text, blocks(text, size), _split()
        self.counts = [len(self.split(text[a:b])) for a, b in zip(self.starts, self.starts[1:])]
        self.n = sum(self.counts)

    def offset(self, rank: int) -> int:
        """Where the unit of this rank begins; the text's length for n."""
        for start, end, count in zip(self.starts, self.starts[1:], self.counts):
            if rank < count:
                return start + self.split(self.text[start:end])[rank][1][0]
            rank -= count
        return len(self.text)


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    output: str
    prefix: int | None = None
    middle: int | None = None


def transform(text: str, key: str, size: int = BLOCK) -> Cut:
    """What the key's hash makes of a text: the form, the output, and the code points of prefix and middle."""
    units = Units(text, size)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or h[2] % 100 >= CUT or any(s in text for s in SENTINELS):
        return Cut(units.n, "plain", text)
    low, high = sorted(x % (units.n + 1) for x in h[:2])
    a, b = units.offset(low), units.offset(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = SENTINELS
    if h[3] % 100 < SUFFIX_FIRST:
        return Cut(units.n, "spm", f"{s}{suffix}{p}{prefix}{m}{middle}", a, b - a)
    return Cut(units.n, "psm", f"{p}{prefix}{s}{suffix}{m}{middle}", a, b - a)


def restore(output: str, form: str) -> str:
    """The text that an output was made of. A sentinel has no end that is its beginning, or another's, so the first one
    found is the one that was written."""
    if form == "plain":
        return output
    p, s, m = SENTINELS
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError(f"not of the form {form}")
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    return one + middle + two if form == "psm" else two + middle + one


def cut_documents(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked for, output."""
    fields = [("doc_id", "long", pa.int64()), ("n", "long", pa.int64()), ("form", "string", pa.string()), ("prefix_chars", "long", pa.int64()), ("middle_chars", "long", pa.int64()), ("output_sha256", "string", pa.string()), ("restored_sha256", "string", pa.string())]
    fields += [("output", "string", pa.string())] * texts

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                cut = transform(text.as_py() or "", "" if doc is None else str(doc))
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (cut.output, restore(cut.output, cut.form))]
                for col, x in zip(cols, (doc, cut.n, cut.form, cut.prefix, cut.middle, *digests, cut.output)):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f[2]) for c, f in zip(cols, fields)], names=[f[0] for f in fields])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in fields))


#: The query with lists of matches in place of offsets; a private character parts the units.
OP12_SQL = r"""
with t as (
    select doc_id, coalesce(text, '') x, string_split(regexp_replace(coalesce(text, ''), '([A-Za-z]+|[^A-Za-z])', '\1' || chr(57344), 'g'), chr(57344))[:-2] u, sha256('1:' || coalesce(doc_id::varchar, '')) d from documents
), h as (
    select *, len(u) n, ('0x' || d[1:8])::bigint h1, ('0x' || d[9:16])::bigint h2, ('0x' || d[17:24])::bigint h3, ('0x' || d[25:32])::bigint h4 from t
), c as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) i, greatest(h1 % (n + 1), h2 % (n + 1)) j,
        case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from h
), s as (
    select *, array_to_string(u[1:i], '') p, array_to_string(u[i + 1:j], '') m, array_to_string(u[j + 1:n], '') s from c
)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
    sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(x) restored_sha256 from s
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_documents(documents(spark, sf_dir), texts=False)
