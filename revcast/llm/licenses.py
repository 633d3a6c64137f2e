"""License scans by template matching.

A template's wording has mandatory words, optional regions and replaceable
regions (:mod:`license_templates`). All templates are compiled into one
automaton over words; a text is searched from every word that can begin a
template, and a template is accepted where its mandatory wording stands word
for word. The automaton's deterministic states are made when first needed
and kept, up to a bound, in each worker.

Words are :func:`alnum_words`, of whole texts. Defined results: a null or
wordless text has no words and no matches; of the ways in which a template
fits from one place the longest counts; matches of different templates, and
from different places, may overlap and are all returned; each input row gives
one output row, also when rows repeat. The work is a single pass without a
shuffle; a hot source or a very long text changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, texts_of
from .decontaminate import word_offsets
from .license_templates import BASE, TEMPLATES

_TOKEN = re.compile(r"\[\[|\]\]|\{\*\d+\}|\{[^}]*\}|[^\s\[\]{}]+")


@dataclass
class Template:
    name: str
    label: str
    base: bool
    #: nested parts: ("word", {words}), ("any", n) or ("optional", parts)
    parts: list = field(default_factory=list)

    @staticmethod
    def parse(name: str, label: str, text: str, base: bool = False) -> Template:
        stack: list[list] = [[]]
        for t in _TOKEN.findall(text.lower()):
            if t == "[[":
                stack.append([])
            elif t == "]]":
                inner = stack.pop()
                stack[-1].append(("optional", inner))
            elif t.startswith("{*"):
                stack[-1].append(("any", int(t[2:-1])))
            else:
                stack[-1].append(("word", frozenset(t.strip("{}").split("|"))))
        if len(stack) > 1 or stack[0][0][0] != "word":
            raise ValueError(f"template {name}: unbalanced, or it does not begin with a mandatory word")
        return Template(name, label, base, stack[0])

    def weight(self) -> float:
        """1 - 2**-n for n mandatory words: longer wordings are surer evidence."""
        return 1 - 0.5 ** sum(kind == "word" for kind, _ in self.parts)

    def regex(self) -> str:
        """The same language over a text of blank-separated words, for SQL and tests."""

        def of(parts) -> str:
            out = ""
            for kind, what in parts:
                if kind == "word":
                    out += " " + (min(what) if len(what) == 1 else "(?:" + "|".join(sorted(what)) + ")")
                elif kind == "any":
                    out += f"(?: [^ ]+){{0,{what}}}"
                else:
                    out += f"(?:{of(what)})?"
            return out

        return of(self.parts) + " "


def default_templates() -> list[Template]:
    base = [Template.parse(f"base:{p}", label, p, True) for p, label in BASE.items()]
    return base + [Template.parse(f"{label}:{k}", label, t) for k, (label, t) in enumerate(TEMPLATES)]


class TemplateAutomaton:
    """Word automaton of all templates; deterministic states on demand."""

    MAX_STATES = 50_000

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.arcs: list[dict[bytes, list[int]]] = []  # nondeterministic: word -> next
        self.any: list[list[int]] = []  # next by any word
        self.skip: list[list[int]] = []  # next without a word
        self.accepts: dict[int, int] = {}
        begin = self._state()
        for k, t in enumerate(templates):
            first = self._state()
            self.skip[begin].append(first)
            self.accepts[self._build(t.parts, first)] = k
        self.words = {w for a in self.arcs for w in a}
        self.begin = self._closure([begin])
        self.firsts = {w for s in self.begin for w in self.arcs[s]}
        self._forget()

    def _state(self) -> int:
        self.arcs.append({})
        self.any.append([])
        self.skip.append([])
        return len(self.arcs) - 1

    def _build(self, parts: list, at: int) -> int:
        for kind, what in parts:
            if kind == "word":
                to = self._state()
                for w in what:
                    self.arcs[at].setdefault(w.encode(), []).append(to)
                at = to
            elif kind == "any":
                end = self._state()
                for _ in range(what):
                    self.skip[at].append(end)
                    to = self._state()
                    self.any[at].append(to)
                    at = to
                self.skip[at].append(end)
                at = end
            else:
                end = self._build(what, at)
                self.skip[at].append(end)
                at = end
        return at

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _forget(self) -> None:
        self.number = {self.begin: 0}
        self.sets = [self.begin]
        self.table: list[dict[bytes, int]] = [{}]
        self.done: list[tuple[int, ...]] = [()]

    def _step(self, state: int, word: bytes) -> int:
        """The state after ``word`` (b'' for words of no template); -1 if none."""
        to = self._closure([t for s in self.sets[state] for t in (*self.arcs[s].get(word, ()), *self.any[s])])
        if not to:
            number = -1
        elif (number := self.number.get(to, -2)) == -2:
            number = self.number[to] = len(self.sets)
            self.sets.append(to)
            self.table.append({})
            self.done.append(tuple(sorted(self.accepts[s] for s in to if s in self.accepts)))
        self.table[state][word] = number
        return number

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, end) of each template's longest match from each place."""
        if len(self.sets) > self.MAX_STATES:
            self._forget()
        firsts, known, table, done = self.firsts, self.words, self.table, self.done
        out = []
        for first in [i for i, w in enumerate(words) if w in firsts]:
            found: dict[int, int] = {}
            state = 0
            for i in range(first, len(words)):
                w = words[i] if words[i] in known else b""
                to = table[state].get(w)
                state = self._step(state, w) if to is None else to
                if state < 0:
                    break
                for k in done[state]:
                    found[k] = i + 1
            out += [(k, first, end) for k, end in found.items()]
        return out


_MATCH = "struct<template:string,label:string,base:boolean,weight:double,first:int,end:int,start_char:int,end_char:int>"
_MATCH_ARROW = pa.list_(pa.struct([
    ("template", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("weight", pa.float64()),
    *((n, pa.int32()) for n in ("first", "end", "start_char", "end_char"))]))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[Template] | None = None) -> DataFrame:
    """Per row: the id, n_words and every match: template, label, word span and offsets in the original text."""
    chosen = templates or default_templates()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TemplateAutomaton(chosen)
        for batch in batches:
            n_words, matches = [], []
            for raw in texts_of(batch, "__text"):
                words = alnum_words(raw)
                found = automaton.scan(words)
                at = word_offsets(raw) if found else []
                n_words.append(len(words))
                matches.append([
                    {"template": (t := chosen[k]).name, "label": t.label, "base": t.base, "weight": t.weight(), "first": a,
                     "end": b, "start_char": at[a][0], "end_char": at[b - 1][1]} for k, a, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(n_words, pa.int64()), pa.array(matches, _MATCH_ARROW)], [id_col, "n_words", "matches"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(
        run, f"{id_col} {kind}, n_words bigint, matches array<{_MATCH}>")


def license_report(docs: DataFrame) -> DataFrame:
    """The digest per document; base places come from the base templates' matches."""
    base = F.filter("matches", lambda m: m.base)
    firsts = F.transform(F.col("base"), lambda m: m["first"])
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(F.col(c), lambda m: m.label))))
    return find_licenses(docs).withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(firsts).cast("long").alias("first_word"), F.array_max(firsts).cast("long").alias("last_word"),
        joined("base").alias("base_labels"), joined("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.weight)), F.lit(0.0)).alias("score"))


def oracle_sql() -> str:
    """The same in DuckDB: base places by neighbouring words, templates as expressions over the joined words."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    longest = max(len(p.split()) for p in BASE)
    leads = "".join(f", lead(word, {k}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{k}" for k in range(1, longest))
    place = " ".join(
        "WHEN " + " AND ".join(f"{'word' if k == 0 else f'w{k}'} = '{w}'" for k, w in enumerate(p.split())) + f" THEN '{label}'"
        for p, label in BASE.items())
    tests = [(t.label, t.weight(), t.regex()) for t in default_templates()]
    labels = ", ".join(f"CASE WHEN regexp_matches(joined, '{r}') THEN '{label}' END" for label, _, r in tests)
    scores = ", ".join(f"CASE WHEN regexp_matches(joined, '{r}') THEN {w!r}::DOUBLE ELSE 0.0::DOUBLE END" for _, w, r in tests)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM d),
near AS (SELECT doc_id, pos, word{leads} FROM w),
place AS (SELECT * FROM (SELECT doc_id, pos, CASE {place} END AS label FROM near) WHERE label IS NOT NULL),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id),
t AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS joined FROM d)
SELECT t.doc_id, n_words, coalesce(n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct([{labels}])), ',') AS labels,
       greatest({scores}) AS score
FROM t LEFT JOIN base USING (doc_id)"""
