"""Secret scan: strong patterns, and multipart credentials linked within scopes.

Assignments, access keys and long hexadecimal runs always count. Identifiers, weakly marked
secrets and endpoints count only if their complement is in the same scope, with a gap of at most
SCOPE characters between the two: a weak secret needs an identifier, an identifier a secret, an
endpoint both. The join by interval runs inside the document's row, over its parts ordered by start:
for each role, the last end before a part (a running maximum) and the next start after it decide,
however long the parts are. No rows are shuffled, and one cheap pattern decides whether a text is
searched at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, table

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: kind, role, pattern, least characters of the match (of its group where it has one)
KINDS = (
    ("assign", "secret", rf"(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", 6),
    ("access", "id", r"AKIA[A-Z0-9]+", 20),
    ("hex", "secret", r"[0-9a-f]{24,}", 24),
    ("identifier", "id", rf"(?i:client_?id|access_?key_?id|account_?id|app_?id|tenant_?id|username|login){_VALUE}([A-Za-z0-9._@+-]{{3,}})", 3),
    ("weak", "secret", rf"(?i:private_?key|credential|passphrase|bearer|auth|pwd){_VALUE}([A-Za-z0-9+/_.=~-]{{6,}})", 6),
    ("endpoint", "endpoint", r"(?i:https?|jdbc:[a-z]{2,12}|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:/?#@%&=+-]{4,}", 0),
)
STRONG = ("assign", "access", "hex")
#: What a text must contain for any pattern to match.
GUARD = ("(?i:password|passwd|secret|token|api_?key|client_?id|access_?key|account_?id|app_?id|"
         "tenant_?id|username|login|private_?key|credential|passphrase|bearer|auth|pwd)"
         r"""["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|://""")
#: Most characters between the parts of a scope.
SCOPE = 200
_BLOCK = 256


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _running(df: DataFrame, name: str, total=_sum, add=Column.__add__) -> DataFrame:
    """Replace the array ``name`` by its running sums (or what else is given), block by block."""
    blocks = F.ceil(F.size(name) / _BLOCK).cast("int")
    df = bound(df, _sums=F.when(F.size(name) > 0, F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda b: total(F.slice(name, b * _BLOCK + 1, _BLOCK)))))
    df = bound(df, _before=F.transform("_sums", lambda _, b: total(F.slice("_sums", F.lit(1), b))))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    sums = F.transform(F.col(name), lambda _, i: add(F.get("_before", block(i)), total(
        F.slice(name, block(i) * _BLOCK + 1, i - block(i) * _BLOCK + 1))))
    df = bound(df, _new=sums).drop(name, "_sums", "_before")
    return df.withColumnRenamed("_new", name)


def _spans(df: DataFrame, kind: str, role: str, pattern: str, least: int, in_bytes: bool = False) -> DataFrame:
    """Add the array ``kind`` of spans; df has body, null where there is nothing to find.

    With ``in_bytes`` spans also have byte, where they start, and bytes, their length.
    """
    group = 1 if "(" in pattern.replace("(?", "") else 0
    p = F.lit(pattern)
    df = bound(df, _m=F.regexp_extract_all("body", p, F.lit(0)),
               _v=F.regexp_extract_all("body", p, F.lit(group)),
               _gap=F.split("body", pattern, -1))
    sizes = {"_at": F.length, "_byte": F.octet_length} if in_bytes else {"_at": F.length}
    for name, size in sizes.items():
        df = bound(df, **{name: F.transform("_m", lambda m, i: size(F.get("_gap", i)) + F.coalesce(
            size(F.get("_m", i - 1)), F.lit(0)))})
        df = _running(df, name)
    more = lambda m, i: [F.get("_byte", i).alias("byte"), F.octet_length(m).alias("bytes")]
    spans = F.transform("_m", lambda m, i: F.struct(
        F.get("_at", i).alias("start"), (F.get("_at", i) + F.length(m)).alias("end"),
        F.lit([k[0] for k in KINDS].index(kind)).alias("ord"), F.lit(kind).alias("kind"),
        F.lit(role).alias("role"), F.length(F.get("_v", i)).alias("n"), *(more(m, i) if in_bytes else ())))
    good = F.filter(spans, lambda s: s["n"] >= least)
    return bound(df, **{kind: good}).drop("_m", "_v", "_gap", *sizes)


def scan_secrets(docs: DataFrame, text: str = "text", in_bytes: bool = False) -> DataFrame:
    """Every row of ``docs`` below ``row``, with its strong spans and all reported spans.

    base and spans are arrays of start, end, ord, kind, role, n, by start and kind; positions are
    code points, the end exclusive. Null or empty text: empty arrays. A span is reported once for
    each row, so repeated rows repeat it. Other columns stay below ``row``. With ``in_bytes`` spans also have
    byte and bytes, their start and length in UTF-8.
    """
    df = docs.select(F.struct("*").alias("row"))
    df = bound(df, body=F.when(F.col("row")[text].rlike(GUARD), F.col("row")[text]))
    kinds = [k[0] for k in KINDS]
    for k in KINDS:
        df = _spans(df, *k, in_bytes)
    none = F.array().cast("array<struct<start:int,end:int,ord:int,kind:string,role:string,n:int"
                          + (",byte:int,bytes:int>>" if in_bytes else ">>"))
    df = bound(df.drop("body"), parts=F.coalesce(F.sort_array(F.concat(*kinds)), none))

    for role in ("id", "secret"):  # nulls, where the role is another, count for nothing
        df = bound(df, **{
            f"_{role}_end": F.transform("parts", lambda p: F.when(p["role"] == role, p["end"])),
            f"_{role}_start": F.transform(F.reverse("parts"), lambda p: F.when(p["role"] == role, -p["start"]))})
        for name in (f"_{role}_end", f"_{role}_start"):
            df = _running(df, name, F.array_max, F.greatest)

    def near(p: Column, i: Column, role: str) -> Column:
        before = p["start"] - F.get(f"_{role}_end", i - 1)
        after = -F.get(f"_{role}_start", F.size("parts") - 2 - i) - p["end"]
        return F.coalesce(F.least(before, after) <= SCOPE, F.lit(False))

    def report(p: Column, i: Column) -> Column:
        return (p["kind"].isin(*STRONG)
                | ((p["role"] == "secret") & near(p, i, "id"))
                | ((p["role"] == "id") & near(p, i, "secret"))
                | ((p["role"] == "endpoint") & near(p, i, "id") & near(p, i, "secret")))

    return df.select("row", F.filter("parts", lambda p: p["kind"].isin(*STRONG)).alias("base"),
                     F.filter("parts", report).alias("spans"))


def digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]",
           length: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every reported span replaced by ``mark``.

    Overlapping spans become one mark. A column ``length``, if there is one, follows changed texts. Null and
    empty texts stay as they are, repeated rows change alike, and the work grows with the length of a text and
    its number of spans: pieces are cut from bytes, where a place is found without counting characters.
    """
    found = scan_secrets(docs, text, True)
    found = bound(found, body=F.col("row")[text].cast("binary"),
                  _ends=F.transform("spans", lambda s: s["byte"] + s["bytes"]))
    found = _running(found, "_ends", F.array_max, lambda a, b: F.greatest(a, b))

    def cut(s: Column, i: Column) -> Column:
        """The text between the end of all earlier spans and this start, or null inside them."""
        before = F.coalesce(F.get("_ends", i - 1), F.lit(0))
        return F.when(s["byte"] >= before, F.concat(F.substring(
            F.col("body"), before + 1, s["byte"] - before).cast("string"), F.lit(mark)))

    end = F.get("_ends", F.size("spans") - 1)
    new = F.when(F.size("spans") > 0, F.concat(
        F.array_join(F.transform("spans", cut), ""),
        F.substring(F.col("body"), end + 1, F.octet_length("body")).cast("string"))).otherwise(F.col("row")[text])
    found = bound(found, fresh=new)
    made = {text: F.col("fresh")}
    if length in docs.columns:
        made[length] = F.when(F.size("spans") > 0, F.length("fresh")).otherwise(
            F.col("row")[length]).cast(docs.schema[length].dataType)
    return found.select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of strong spans, their digest, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("row.doc_id", *(count(k).alias(f"n_{k}") for k in STRONG),
                        F.sha2(digest("base"), 256).alias("base_sha256"),
                        digest("spans").alias("spans"))
