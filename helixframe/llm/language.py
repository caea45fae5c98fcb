"""Language of web pages by Bayesian evidence fusion.

The log posterior of a language adds the tempered log likelihood of the page's text under a character trigram model
of each language (trained on the labelled documents), the log likelihoods of the declared markup language and of the
address suffix, and the log prior of the host. The prior is smoothed hierarchically: host towards its domain, domain
towards all pages. Likelihoods and priors come from grouped counts over all pages of the languages that their texts
alone suggest; a page's own count is taken out before it is judged.

Edge cases: a null or empty page has no text evidence, the rest decides; without address or declaration there is an
empty value, which counts like any other; ties go to the first language in alphabetical order; repeated rows are judged
alike; with no labelled documents there is no language, and every page gets null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charlm import SYMBOLS, log_model, symbols, trigram_counts_by
from .common import Scratch, documents

TEMPER = 0.1  # neighbouring characters are no independent evidence
HOST_WEIGHT = 5.0
DOMAIN_WEIGHT = 10.0
SMOOTH = 0.5
LONG_TAG = 4096  # characters of a tag that are read for its language

OPENS = re.compile(r"(?i)<(?:(script|style|template|noscript)\b|!--|!doctype)")
ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "template", "noscript")} | {"--": re.compile("-->"), "!": re.compile(">")}
TAG = re.compile(r"<[^>]*>")
SPEAKS = re.compile(r"(?i)<(html|meta)\b")
LANG = re.compile(r"(?i)\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,8})")
CONTENT = re.compile(r"(?i)content-language.*?\bcontent\s*=\s*[\"']?\s*([a-z]{2,8})", re.S)


def visible(page: str) -> str:
    """The text between tags, without scripts and the like. Time grows with the page's length: a kind of end that isn't
    found once is not looked for again."""
    out, at, gone = [], 0, set()
    for m in OPENS.finditer(page):
        if m.start() < at:
            continue
        kind = m[1].lower() if m[1] else "--" if m[0] == "<!--" else "!"
        end = None if kind in gone else ENDS[kind].search(page, m.end())
        if end is None:
            gone.add(kind)
        else:
            out += [page[at : m.start()], " "]
            at = end.end()
    text = "".join([*out, page[at:]])
    cut = text.rfind(">") + 1  # behind it no tag ends
    return markup.unescape(TAG.sub(" ", text[:cut]) + text[cut:])


def declared(page: str) -> str:
    """The language of the first html tag that has one, else that of a meta tag."""
    meta = ""
    for m in SPEAKS.finditer(page):
        end = page.find(">", m.end())
        if end < 0:
            break
        tag = page[m.end() : min(end, m.end() + LONG_TAG)]
        if m[1].lower() == "html":
            if found := LANG.search(tag):
                return found[1].lower()
        elif not meta and (found := CONTENT.search(tag)):
            meta = found[1].lower()
    return meta


def host_of(url: str) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.|\.$", "")


def domain_of(host: str) -> Column:
    """The last two labels, or three under a short second-level label of a country suffix."""
    return F.regexp_extract(host, r"([^.]+\.(?:[a-z]{2,3}\.[a-z]{2}|[^.]+))$", 1)


def suffix_of(host: str) -> Column:
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def text_evidence(pages: DataFrame, models: np.ndarray) -> DataFrame:
    """page_id, url, declared, text_chars and ll, the log likelihood under each language's model."""
    flat = models.reshape(len(models), -1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                says, chars, lls = [], [], []
                for page in part.column(2):
                    page = page.as_py() or ""
                    s = symbols("\n\n" + visible(page) + "\n\n")
                    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                    code = code[(s[2:] > 0) | (s[1:-1] > 0)]  # runs of blanks say nothing
                    says.append(declared(page))
                    chars.append(int((s > 0).sum()))
                    lls.append(flat[:, code].sum(1, dtype=np.float64).tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(says, pa.string()), pa.array(chars, pa.int64()), pa.array(lls, pa.list_(pa.float64()))], names=["page_id", "url", "declared", "text_chars", "ll"])

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(run, "page_id long, url string, declared string, text_chars long, ll array<double>")


def fuse(rows: DataFrame, langs: list[str], scratch: Scratch, temper: float = TEMPER, host_weight: float = HOST_WEIGHT, domain_weight: float = DOMAIN_WEIGHT, smooth: float = SMOOTH) -> DataFrame:
    """Adds suffix, domain, host, lang and confidence to text evidence."""
    n = len(langs)
    rows = rows.withColumn("host", host_of("url")).withColumn("domain", domain_of("host")).withColumn("suffix", suffix_of("host"))
    # the language that the text alone suggests, or none
    rows = rows.withColumn("best", F.when(F.col("text_chars") > 0, F.array_position("ll", F.array_max("ll")) - 1).cast("int"))
    tally = lambda: F.array(*(F.count_if(F.col("best") == i) for i in range(n)))
    total = rows.agg(tally().alias("t")).first()["t"]
    n_suffix, n_declared = rows.agg(F.approx_count_distinct("suffix"), F.approx_count_distinct("declared")).first()
    out = rows
    for key in ("declared", "suffix", "host", "domain"):
        # written, so that a join that isn't a broadcast reads two plain shuffles, whose hot keys are split
        counts = scratch.save(rows.groupBy(key).agg(tally().alias(f"n_{key}")), key)
        out = out.join(counts, key)
    scores = []
    for i in range(n):
        own = (F.coalesce(F.col("best"), F.lit(-1)) == i).cast("int")  # a page is no evidence about itself
        known = F.col("best").isNotNull().cast("int")
        less = lambda key: F.col(f"n_{key}")[i] - own  # noqa: E731, B023
        size = lambda key: F.aggregate(f"n_{key}", F.lit(0).cast("long"), lambda a, b: a + b) - known  # noqa: E731, B023
        overall = (total[i] - own + 1.0) / (sum(total) - known + n)
        domain = (less("domain") + domain_weight * overall) / (size("domain") + domain_weight)
        host = (less("host") + host_weight * domain) / (size("host") + host_weight)
        said = F.log((less("declared") + smooth) / (total[i] - own + smooth * max(1, n_declared)))
        suffix = F.log((less("suffix") + smooth) / (total[i] - own + smooth * max(1, n_suffix)))
        scores.append(temper * F.col("ll")[i] + said + suffix + F.log(host))
    out = out.withColumn("s", F.array(*scores)).withColumn("top", F.array_max("s"))
    names = F.array(*map(F.lit, langs))
    out = out.withColumn("lang", F.element_at(names, F.array_position("s", F.col("top")).cast("int")))
    text_lang = F.when(F.col("best").isNotNull(), F.element_at(names, F.col("best") + 1))
    confidence = 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return out.select("page_id", "lang", confidence.alias("confidence"), text_lang.alias("text_lang"), "declared", "suffix", "domain", "host", "text_chars")


def identify(pages: DataFrame, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, lang, confidence and the evidence, for each page."""
    scratch = scratch or Scratch(pages.sparkSession, "language")
    counts = trigram_counts_by(docs, "lang")
    if not counts:
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"), *(none.alias(c) for c in ("text_lang", "declared", "suffix", "domain", "host")), F.lit(None).cast("long").alias("text_chars"))
    models = np.stack([log_model(c) for c in counts.values()])
    return fuse(scratch.save(text_evidence(pages, models), "evidence"), list(counts), scratch)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))
