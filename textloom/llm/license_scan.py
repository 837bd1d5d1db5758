"""License scan: sparse TF-IDF cosine to templates, then directory inheritance.

Units of a file are its lines, its blocks of several lines (between lines without
letter or digit, so comment marks don't matter), and the whole text of a licence
file (by its name).  A unit is a sparse vector of terms ``[a-z0-9]+``, weighted by
the documents that hold them; a term outside the templates weighs like one seen
once.  Licences share paragraphs, so a file's own licence is the one of most
evidence: the sum, over units, of its best template's cosine where that reaches
``threshold``; ``own_score`` is the largest of these cosines.  A file without one inherits from the licence
file in its nearest ancestor directory: directories are joined with their
ancestors' paths, files with their directory.

Only the templates' terms, a fixed vocabulary, are counted and sent to tasks.
Units that cannot reach the threshold fall to an upper bound, the squared weight
that their terms can share with any template.

Defined cases: null or empty text has no licence of its own; very long texts are
judged whole, unit by unit; ties (to nine
digits) go to the licence first by name; of several licence files in a
directory the first by path (then by licence) is inherited; rows without a path
inherit nothing; repeated rows and paths are judged row by row; an empty table
gives an empty table; other columns pass through, and the operator's columns
replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unwrapped, wrapped, written
from .license_texts import TEMPLATES

THRESHOLD = 0.7
LICENCE_FILE = r"(?i)^(LICEN[CS]E|COPYING|NOTICE|UNLICENSE)(\..*)?$"
_FIND = re.compile("[a-z0-9]+").findall
_BLANK = re.compile(r"\n[^\w\n]*\n")


def terms_of(text: str) -> list[str]:
    return _FIND(text.lower())


class Model:
    """Weights of the templates' terms, and the templates' unit vectors by term."""

    def __init__(self, templates: dict[str, list[str]], counts: dict[str, int], files: int):
        self.files = files
        self.idf = {t: self._idf(n) for t, n in counts.items()}
        self.other = self._idf(1)
        self.names, self.of_term, self.bound, self.licence = sorted(templates), {}, {}, []
        for at, name in enumerate(self.names):
            for block in [*templates[name], " ".join(templates[name])]:
                weights, norm = self.vector(terms_of(block))
                for t, x in weights.items():
                    self.of_term.setdefault(t, []).append((len(self.licence), x / norm))
                    self.bound[t] = max(self.bound.get(t, 0.0), (x / norm) ** 2)
                self.licence.append(at)

    def _idf(self, n: int) -> float:
        return math.log((1 + self.files) / (1 + n)) + 1.0

    def vector(self, terms: list[str]) -> tuple[dict[str, float], float]:
        weights = {t: n * self.idf.get(t, self.other) for t, n in Counter(terms).items()}
        return weights, math.sqrt(sum(x * x for x in weights.values())) or 1.0

    def may_reach(self, terms: list[str], least: float) -> bool:
        get = self.bound.get
        return sum([get(t, 0.0) for t in set(terms)]) >= least

    def cosines(self, terms: list[str]) -> dict[str, float]:
        """The largest cosine with a template of each licence."""
        weights, norm = self.vector(terms)
        scores = [0.0] * len(self.licence)
        for t, x in weights.items():
            for i, y in self.of_term.get(t, ()):
                scores[i] += x * y
        best: dict[str, float] = {}
        for at, x in zip(self.licence, scores):
            best[self.names[at]] = max(best.get(self.names[at], 0.0), x / norm)
        return best


def units_of(text: str, whole: bool) -> Iterator[str]:
    """Lines, blocks of several lines, and all of it."""
    yield from text.split("\n")
    yield from (b for b in _BLANK.split(text) if "\n" in b)
    if whole:
        yield text


def own_license(model: Model, text: str | None, whole: bool, threshold: float) -> tuple[str | None, float | None]:
    """The licence of most evidence, and its largest cosine."""
    evidence, top, least = {}, {}, threshold * threshold - 1e-9
    if text and model.may_reach(terms_of(text), least):
        for unit in units_of(text, whole):
            terms = terms_of(unit)
            if terms and model.may_reach(terms, least):
                for name, x in model.cosines(terms).items():
                    if x >= threshold:
                        evidence[name] = evidence.get(name, 0.0) + x
                        top[name] = max(top.get(name, 0.0), x)
    if not evidence:
        return None, None
    name = min(evidence, key=lambda n: (-round(evidence[n], 9), n))
    return name, top[name]


def license_scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` and ``own_license, own_score, license, inherited_from``."""
    templates = templates or TEMPLATES
    small_batches(files.sparkSession)
    spark = files.sparkSession
    known = frozenset(t for blocks in templates.values() for b in blocks for t in terms_of(b))
    rows = wrapped(files)
    at, body = F.col("row").getField(path).cast("string"), F.col("row").getField(text)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = Counter(), 0
        for pdf in batches:
            n += len(pdf)
            for t in pdf["text"]:
                held.update(known.intersection(terms_of(t or "")))
        yield pd.DataFrame({"term": ["", *held], "n": [n, *held.values()]})

    # One row a term of the vocabulary, and one (the empty term) for the number of files.
    counted = rows.select(body.alias("text")).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in counted.collect()}
    model = spark.sparkContext.broadcast(Model(templates, {t: n for t, n in counts.items() if t}, counts.get("", 0)))

    @F.pandas_udf("name string, score double")
    def judged(texts: pd.Series, licence_file: pd.Series) -> pd.DataFrame:
        found = [own_license(model.value, t, bool(w), threshold) for t, w in zip(texts, licence_file)]
        return pd.DataFrame(found, columns=["name", "score"]).astype({"score": "float64"})

    named = F.coalesce(F.element_at(F.split(at, "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    rows = rows.withColumns({"path": at, "named": named, "folder": F.regexp_replace(at, "/?[^/]*$", "")})
    own = written(rows.withColumn("own", judged(body, F.col("named"))), "own")  # texts are judged once, and read thrice at most
    given = own.where("named and own.name is not null").groupBy("folder").agg(F.min(F.struct("path", F.col("own.name").alias("license"))).alias("given"))
    given = written(given, "given")

    parts = F.split("wants", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = F.array_distinct(F.concat(F.array(F.lit("")), above))
    folders = own.where("folder is not null").select(F.col("folder").alias("wants")).distinct()
    near = folders.select("wants", F.explode(above).alias("folder")).join(given, "folder")
    heirs = near.groupBy("wants").agg(F.max_by("given", F.length("folder")).alias("given"))
    found = own.join(heirs, own["folder"] == heirs["wants"], "left")
    lacks = F.col("own.name").isNull()
    return unwrapped(found, {
        "own_license": F.col("own.name"),
        "own_score": F.col("own.score"),
        "license": F.when(lacks, F.col("given.license")).otherwise(F.col("own.name")),
        "inherited_from": F.when(lacks, F.col("given.path")),
    })
