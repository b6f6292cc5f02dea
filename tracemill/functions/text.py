"""Column functions on text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that aren't counted as BM25 tokens.
STOPWORDS = """a about above after again against ain all am an and any are aren as at be because been before being below between
both but by can couldn d did didn do does doesn doing don down during each few for from further had hadn has hasn
have haven having he her here hers herself him himself his how i if in into is isn it its itself just ll m ma me
mightn more most mustn my myself needn no nor not now o of off on once only or other our ours ourselves out over own
re s same shan she should shouldn so some such t than that the their theirs them themselves then there these they
this those through to too under until up ve very was wasn we were weren what when where which while who whom why
will with won wouldn y you your yours yourself yourselves""".split()

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space at either end (SQL's trim takes only spaces)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def non_empty(text: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def display(text: Column) -> Column:
    return F.coalesce(non_empty(text), F.lit("<empty>"))


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def bm25_tokens(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(STOPWORDS))


def echo_key(claim: Column) -> Column:
    """A claim's words in lower case, without a leading number: claims that say the same have the same key."""
    bare = F.regexp_replace(claim, r"^\s*\d+\.\s+", "")
    return F.array_join(F.regexp_extract_all(F.lower(bare), F.lit(r"([\p{L}\p{N}_]+)"), 1), " ")


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def decode_payload(text: Column) -> Column:
    """JSON text in its compact form; other text as a JSON string."""
    parsed = F.try_parse_json(text)
    return F.when(text.isNull(), None).when(parsed.isNotNull(), F.to_json(parsed)).otherwise(F.to_json(F.struct(text.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("t")))) - 6))


def sanitise(text: Column) -> Column:
    """Without NUL characters, which stores refuse."""
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def truncated(text: Column, limit: int, mark: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def embedding_text(title: Column, text: Column) -> Column:
    """The title, a blank line and the text; the text alone if the title opens it as a whole word."""
    opens = F.startswith(text, title) & ~F.coalesce(F.regexp_like(F.substring(text, F.length(title) + 1, F.lit(1)), F.lit(r"^[\p{L}\p{N}_-]")), F.lit(False))
    return F.when(F.coalesce(title, F.lit("")) == "", text).when(opens, text).when(F.coalesce(text, F.lit("")) == "", title).otherwise(F.concat(title, F.lit("\n\n"), text))


def paragraphs(*parts: Column) -> Column:
    """A prompt's paragraphs; those with a missing variable are null and left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n\n")


def relevant_ids(value: Column) -> tuple[Column, Column]:
    """Ids of a JSON ground truth and its fault: strings or objects with an id, stripped, blank ones dropped, as a set."""
    listed = F.try_variant_get(F.try_parse_json(value), "$.relevant_ids", "array<variant>")
    whole = F.schema_of_variant(F.try_parse_json(value))
    ids = F.transform(listed, lambda x: F.coalesce(F.when(F.schema_of_variant(x).startswith("OBJECT"), _string(x, "$.id")), _string(x, "$")))
    clean = F.array_distinct(F.filter(F.transform(ids, strip), lambda x: x.isNotNull() & (x != "")))
    fault = F.when(whole.isNull() | ~whole.startswith("OBJECT"), "ground_truth_value must be an object.").when(listed.isNull(), "ground_truth_value.relevant_ids must be a list.")
    return clean, fault


def _string(x: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(x, path, "string"))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a name in a namespace, itself a UUID's text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
