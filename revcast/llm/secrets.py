"""Secret scans with a random forest that removes false positives; DataFrame operations only.

Candidates are runs of at least 16 characters that keys are written in, with
dotted tokens whole; values of any length assigned to a credential's name; and
blocks of private keys (PEM). Each is described by its length, its kinds of characters and the transitions
between them, how much of it common syllables cover, whether it stands in a
path, address or example, and which words stand before it.

Sure evidence decides by itself: known key formats, private key blocks, signed
tokens, credentials of an address or an Authorization header, and values with
letters and digits assigned to a credential's name are secrets; digests after
a hash word, UUIDs and placeholders without such a name are none. A random
forest, trained from labelled findings, decides about all other candidates.

The forest is trained by Spark ML on a bounded sample of findings, drawn and
weighted evenly by their kinds, and then written out as one SQL expression, so that a document is scanned, judged and
redacted in its own row: no shuffle, no Python, whatever the size of a
document or source.

Labelled findings are a table (value, before, after, label). ``weak_labels``
makes one from the corpus itself: sure evidence counts as above; plain words
and calls are none. What the rule cannot decide (other named values, and
random-looking ones without a name) has label null and teaches nothing; any
other candidate is none. Candidates of every fifth document are held out.

Defined results: null and empty texts have no candidates; rows, also repeated
ones, are judged one by one; without findings of both labels nothing is
learned and sure evidence alone counts; all columns of a redacted table stay as they were.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, via_table

REDACTED = "[SECRET]"
#: Findings of each kind and label that the forest learns from, at most.
SAMPLE = 2_000
TREES, DEPTH, SEED = 15, 5, 7
#: Characters before and after a candidate that are looked at, other candidates included.
BEFORE, AFTER = 48, 16
#: Candidates that fit into these: each, with what parts it from the next, has four characters at least.
_BACK, _ON = BEFORE // 4, AFTER // 4

# Names that credentials are assigned to, prefixes of public key formats, placeholder words.
_NAMES = "token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|bearer"
_PREFIX = "^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|sk-|AIza|eyJ|SG[.]|-----BEGIN [A-Z0-9 ]*PRIVATE KEY)"
# Whole key formats, by their prefixes and least lengths.
_FORMATS = [
    "(AKIA|ASIA)[A-Z0-9]{16}", "gh[pousr]_[A-Za-z0-9]{20,}", "github_pat_[A-Za-z0-9_]{20,}", "glpat-[A-Za-z0-9_-]{16,}",
    "xox[abprs]-[A-Za-z0-9-]{10,}", "[sr]k_live_[A-Za-z0-9]{16,}", "sk-[A-Za-z0-9_-]{20,}", "AIza[A-Za-z0-9_-]{30,}",
    "SG[.][A-Za-z0-9_-]{16,}[.][A-Za-z0-9_-]{16,}", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{2,}[.][A-Za-z0-9_-]{8,}",
]
_ASSIGN = "[=:]{1,2}>?"
_EXAMPLE = "example|placeholder|changeme|dummy|sample|xxxx|your[_-]"
_PLACEHOLDER = f"{_EXAMPLE}|0000000|1234567"
# Common syllables and short words of the languages at hand.
_SYLLABLES = "the|and|ing|ion|tion|ent|her|ter|ver|ment|con|pro|com|ted|est|ers|all|for|ich|ein|sch|ung|keit|lich|heit|ber|que|eau|aux|ait|ous|des|les|ado|nte|cio|ien|one|tin|on|er|en|re|an|in|th|he|ch|ou|le|de|es"
# The text before a candidate without other candidates, unless one is the name it is assigned to.
_APART = f"regexp_replace(c.before, '[A-Za-z0-9+/_-]{{16,}}+(?![\"'' ]*({_ASSIGN})?[\"'' ]*$)', ' ')"

#: name -> value of a candidate c (value, before, after); all are computed in one pass over the value or its neighbours
_FEATURES = {
    "length": "least(length(c.value), 200)",
    "digits": "length(regexp_replace(c.value, '[^0-9]', '')) / length(c.value)",
    "upper": "length(regexp_replace(c.value, '[^A-Z]', '')) / length(c.value)",
    "digit_transitions": "(regexp_count(c.value, '[A-Za-z](?=[0-9])') + regexp_count(c.value, '[0-9](?=[A-Za-z])')) / length(c.value)",
    "case_transitions": "(regexp_count(c.value, '[a-z](?=[A-Z])') + regexp_count(c.value, '[A-Z](?=[a-z])')) / length(c.value)",
    "vowel_transitions": "regexp_count(lower(c.value), '[aeiou](?=[^aeiou0-9])') / length(c.value)",
    "distinct": "size(array_distinct(split(substring(c.value, 1, 200), ''))) / least(length(c.value), 200)",
    "hex": "if(c.value rlike '^[0-9a-fA-F]+$', 1, 0)",
    "dictionary": f"1 - length(regexp_replace(lower(c.value), '{_SYLLABLES}', '')) / length(c.value)",
    "prefix": f"if(c.value rlike '{_PREFIX}', 1, 0)",
    "path": "if(c.value rlike '/' or c.before rlike '[/.@\\\\\\\\]$' or c.after rlike '^([@/]|[.][a-z])', 1, 0)",
    "assigned": "if(c.before rlike '[=:]>?[\"'' ]*$', 1, 0)",
    "named": f"if(c.before rlike '(?i)({_NAMES})[\"'' ]*({_ASSIGN})?[\"'' ]*$', 1, 0)",
    "quoted": "if(c.before rlike '[\"''`]$', 1, 0)",
    "placeholder": f"if(lower(concat({_APART}, c.value)) rlike '{_PLACEHOLDER}', 1, 0)",
    "hash_word": "if(c.before rlike '(?i)(commit|sha1|sha256|md5|hash|revision|checksum|uuid|etag)[^a-z]*$', 1, 0)",
}
_ASSIGNED = f"c.before rlike '(?i)({_NAMES})[\"'' ]*{_ASSIGN}[\"'' ]*$'"
_MIXED = "c.value rlike '[0-9]' and c.value rlike '[A-Za-z]'"
_RANDOM = (f"{_MIXED} and length(c.value) >= 16 and size(array_distinct(split(substring(c.value, 1, 200), ''))) >= 8 "
           f"and {_FEATURES['digit_transitions']} + {_FEATURES['case_transitions']} >= 0.2D")
_HEADER = "(?i)authorization[\"'' ]{0,3}:[\"'' ]{0,3}(basic|bearer) {1,2}$"
_UUID = "c.value rlike '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$'"
_IN_PLACE = "(c.before rlike '[/.@\\\\\\\\]$' or c.after rlike '^([@/]|[.][a-z])')"
_IS_PLACEHOLDER = f"lower(concat({_APART}, c.value)) rlike '{_PLACEHOLDER}'"
#: kind -> sure evidence of a secret, and of none; the first that holds is the kind of a candidate
_SURE = {
    "pem": "c.value rlike '^-----BEGIN' and c.value rlike '[A-Za-z0-9+/]{40}'",
    "format": f"c.value rlike '^({'|'.join(_FORMATS)})$' and not lower(c.value) rlike '{_EXAMPLE}'",
    "address": "c.before rlike '://[^\\\\s/:@]{1,40}:$' and c.after rlike '^@'",
    "header": f"c.before rlike '{_HEADER}'",
    "named": f"{_ASSIGNED} and not {_IS_PLACEHOLDER} and not c.after rlike '^[(\\\\[]' and {_MIXED} and length(c.value) >= 6 "
             "and not c.value rlike '://|^[a-z_][a-z0-9_]*([.][a-z_][a-z0-9_]*)+$'",
}
_NONE = {
    "placeholder": _IS_PLACEHOLDER,
    "digest": f"{_FEATURES['hash_word']} = 1 and not {_ASSIGNED}",
    "uuid": f"{_UUID} and not {_ASSIGNED}",
}
#: Kinds that the rule calls none, but that the forest may judge otherwise.
_LIKELY_NONE = {
    "call": f"{_ASSIGNED} and (c.after rlike '^[(\\\\[]' or (c.value rlike '^[A-Za-z]?[a-z]*$' and not c.before rlike '[\"'']$'))",
    "path": f"{_IN_PLACE} and not {_ASSIGNED}",
    "words": f"not ({_RANDOM}) and not {_ASSIGNED} and {_FEATURES['dictionary']} >= 0.6D",
    "other": f"not ({_RANDOM}) and not {_ASSIGNED}",
}
#: The kind of a candidate; null is undecided.
_KIND = "case " + " ".join(f"when {e} then '{k}'" for k, e in {**_SURE, **_NONE, **_LIKELY_NONE}.items()) + " end"


def _decided(kinds) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


#: The labelling rule of ``weak_labels``: 1, 0 or null (undecided).
_RULE = f"case when ({_KIND}) in {_decided(_SURE)} then 1 when ({_KIND}) is not null then 0 end"


def _candidate() -> str:
    """The pattern of a candidate; loops are possessive, and looking back is bounded."""
    pem = "PRIVATE KEY(?: BLOCK)?-----"
    begin, name = f"-----BEGIN [A-Z0-9 ]{{0,40}}{pem}", f"(?i:{_NAMES})[\"' ]{{0,3}}{_ASSIGN}"
    end = f"-----END [A-Z0-9 ]{{0,40}}{pem}"
    quoted = [f"(?<=[=:>] {{0,3}}{q})(?<={name} {{0,3}}{q})[^{q}\r\n]{{1,200}}+(?={q})" for q in "\"'"]
    # up to a blank, quote or bracket, or to the next assignment of a list
    plain = f"(?<={name}[\"' ]{{0,3}})(?![=:>,;&])(?:[^\\s\"'`,;&<>(){{}}\\[\\]]|[,;&](?=[^\\s,;&\"'])(?![\\w.-]+[=:]))++"
    run = "[A-Za-z0-9+/_-]{16,}+(?:\\.[A-Za-z0-9+/_-]{6,}+)*+"
    address = "(?<=:)(?<=://[^\\s/:@]{1,40}:)[^\\s/@:\"'<>]{1,200}+(?=@)"
    header = "(?<=[cCrR] {1,2})(?<=(?i:authorization)[\"' ]{0,3}:[\"' ]{0,3}(?i:basic|bearer) {1,2})[A-Za-z0-9+/=_.~-]{6,}+"
    return "|".join([
        f"{begin}(?:(?:[^-]|-(?!----))*+{end}|(?:\\s*+[A-Za-z0-9+/=]{{16,}}+)*+)",  # the second: cut off
        f"(?<=[=:>\"' ])(?<=[=:>][\"' ]{{0,3}})(?:{'|'.join([*quoted, plain])})",  # cheap looks back first
        address, header,
        f"(?<![A-Za-z0-9+/_])(?:{run}|SG\\.{run})"])


CANDIDATE = _candidate()


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __values (the candidates), __parts (the text between them)
    and __found: an array of (value, before, after)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = docs.withColumn("__text", text).withColumn("__values", F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0)))
    cut = cut.withColumn("__parts", F.when(F.size("__values") > 0, F.split("__text", CANDIDATE, -1)).otherwise(F.array("__text")))
    # what a part and the candidate after it add to the neighbourhood of others
    cut = cut.drop("__text").withColumn("__near", F.expr(f"""transform(__parts, (p, i) -> named_struct('own', right(p, {BEFORE}),
        'tail', concat(right(p, {BEFORE}), right(coalesce(get(__values, i), ''), {BEFORE})),
        'head', concat(left(p, {AFTER}), left(coalesce(get(__values, i), ''), {AFTER}))))"""))
    return cut.withColumn("__found", F.expr(f"""
        if(size(__values) = 0, cast(array() as array<struct<value:string,before:string,after:string>>),
           transform(__values, (v, i) -> named_struct('value', v,
               'before', if(length(__near[i].own) = {BEFORE}, __near[i].own, right(concat(array_join(transform(
                   slice(__near, greatest(i - {_BACK - 1}, 1), least(i, {_BACK})), n -> n.tail), ''), __near[i].own), {BEFORE})),
               'after', left(array_join(transform(slice(__near, i + 2, {_ON}), n -> n.head), ''), {AFTER}))))""")).drop("__near")


def weak_labels(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(value, before, after, label) of every candidate, by the rule above."""
    # explode_outer: explode makes the optimizer filter by the array's size below, and there the whole text is cut again for every candidate
    found = with_candidates(docs.select(F.col(text_col).alias("text")), "text").select(F.explode_outer("__found").alias("c")).where("c IS NOT NULL")
    judged = found.select("c", F.expr(_KIND).alias("kind"))
    return judged.select("c.value", "c.before", "c.after", F.expr(f"cast(case when kind in {_decided(_SURE)} then 1 when kind is not null then 0 end as int)").alias("label"))


def _features(findings: DataFrame) -> DataFrame:
    rows = findings.withColumn("c", F.struct("value", "before", "after"))
    return rows.select("label", "weight", *(F.expr(e).cast("double").alias(n) for n, e in _FEATURES.items()))


def fit_forest(findings: DataFrame, sample: int = SAMPLE):
    """Spark ML's forest of labelled findings, and the rows that it learned from; None if a label is missing.

    At most ``sample`` distinct findings of each label and kind are taken, in
    the order of a hash of the finding, so the sample does not depend on
    partitions; it is learned from in one partition in that order. All kinds of
    a label weigh alike, and so do both labels: a kind with few findings counts.
    """
    known = via_table(findings.where("label IS NOT NULL").dropDuplicates(["value", "before", "after"]), "findings")  # one scan of the texts
    kinds = known.withColumn("c", F.struct("value", "before", "after")).withColumn("kind", F.coalesce(F.expr(_KIND), F.lit("none"))).drop("c")
    order = [F.xxhash64("value", "before"), F.col("value"), F.col("before"), F.col("after")]
    some = kinds.withColumn("__at", F.row_number().over(Window.partitionBy("label", "kind").orderBy(*order))).where(F.col("__at") <= sample).drop("__at")
    some = via_table(some, "labelled-kinds")
    sizes = some.groupBy("label", "kind").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("weight", 100.0 / F.col("n") / F.count("*").over(Window.partitionBy("label"))).select("label", "kind", "weight")
    names = list(_FEATURES)
    rows = _features(some.join(F.broadcast(sizes), ["label", "kind"]).withColumn("label", F.col("label").cast("double")))
    rows = rows.coalesce(1).sortWithinPartitions("label", *names)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(via_table(rows, "labelled-sample")).coalesce(1).select("label", "weight", "features")
    labels = [r[0] for r in rows.select("label").distinct().collect()]  # at most two
    if len(labels) < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", weightCol="weight",
                                    minInstancesPerNode=2).fit(rows)
    return forest, rows


def train_forest(findings: DataFrame, sample: int = SAMPLE) -> str | None:
    """The forest as an expression over a struct f of features; None if a label is missing."""
    fitted = fit_forest(findings, sample)
    return None if fitted is None else forest_expression(fitted[0])


def forest_expression(forest) -> str:
    trees = [_expression(t._call_java("rootNode"), list(_FEATURES)) for t in forest.trees]
    return "(" + " + ".join(trees) + f") / {len(trees)}"


def _expression(node, names: list[str]) -> str:
    """One tree as nested CASE: a leaf gives its share of secrets."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / sum(stats)!r}D"
    split = node.split()
    return (f"if(f.{names[split.featureIndex()]} <= {split.threshold()!r}D, "
            f"{_expression(node.leftChild(), names)}, {_expression(node.rightChild(), names)})")


def judge(docs: DataFrame, forest: str | None, text_col: str = "text") -> DataFrame:
    """``docs`` with __values, __parts and __scores: 1 or 0 by sure evidence, else
    the forest's share of votes (without a forest 0)."""
    cut = with_candidates(docs, text_col)
    described = ", ".join(f"'{n}', cast({e} as double)" for n, e in _FEATURES.items())
    votes = forest or "0D"
    cut = cut.withColumn("__f", F.expr(f"transform(__found, c -> named_struct('kind', {_KIND}, {described}))")) if forest else \
        cut.withColumn("__f", F.expr(f"transform(__found, c -> named_struct('kind', {_KIND}))"))
    return cut.withColumn("__scores", F.expr(
        f"transform(__f, f -> case when f.kind in {_decided(_SURE)} then 1D when f.kind in {_decided(_NONE)} then 0D else {votes} end)")).drop("__found", "__f")


def _redacted() -> Column:
    return F.expr(f"""array_join(transform(__parts, (p, i) -> if(i < size(__values),
        concat(p, if(__scores[i] >= 0.5, '{REDACTED}', __values[i])), p)), '')""")


def scan_secrets(docs: DataFrame, forest: str | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_candidates, secrets (start, end in characters of the text, score) and the redacted text."""
    judged = judge(docs.select(id_col, text_col), forest, text_col)
    spans = F.expr("""filter(transform(__values, (v, i) -> named_struct(
        'start', aggregate(slice(__parts, 1, i + 1), 0, (n, p) -> n + length(p)) + aggregate(slice(__values, 1, i), 0, (n, w) -> n + length(w)),
        'length', length(v), 'score', __scores[i])), s -> s.score >= 0.5)""")
    return judged.select(id_col, F.size("__values").cast("long").alias("n_candidates"), spans.alias("secrets"), _redacted().alias("redacted"))


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest per document, with a forest learned from weak labels of four fifths of the documents."""
    forest = train_forest(weak_labels(docs.where(crc_mod("doc_id", 5) != 0)))
    found = scan_secrets(docs, forest)
    return found.select(
        "doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s.start.cast("string"), s.length.cast("string"))), ",").alias("spans"),
        F.array_max(F.transform("secrets", lambda s: s.score)).alias("top_score"),
        F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret in ``text_col`` redacted; a text without any, also a null one, stays
    as it was, and ``length_col`` follows the text where it changed."""
    forest = train_forest(weak_labels(docs, text_col))
    judged = judge(docs, forest, text_col).withColumn("__hit", F.exists("__scores", lambda s: s >= 0.5))
    out = judged.withColumn("__new", F.when(F.col("__hit"), _redacted()))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.coalesce("__new", F.col(f"`{c}`")).alias(c))
        elif c == length_col:
            kind = docs.schema[c].dataType
            columns.append(F.when(F.col("__hit"), F.length("__new")).otherwise(F.col(f"`{c}`")).cast(kind).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(columns)
