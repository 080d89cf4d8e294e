"""Secret scans with multipart credential linking, in DataFrame operations only.

One pass over the texts finds parts by pattern. Base parts are findings in themselves. Weak parts (names
of accounts, short or unlabelled secrets, endpoints) are common in harmless text; an interval join over each
document's parts reports them only where a complementary part stands within the same scope: a secret next to
an identifier or endpoint, an identifier or endpoint next to a secret.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import stash, whole_text

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
#: Parts are in one scope if they start within so many code points of each other.
SCOPE = 200


@dataclass(frozen=True)
class Part:
    """A kind of part: its role in a credential, its pattern, and how long `group` of a match must be to count."""

    kind: str
    role: str
    base: bool
    pattern: str
    group: int
    least: int


# The base patterns of the contract, then the weak ones, in the order in which kinds are listed.
PARTS = (
    Part(
        "assign", SECRET, True,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
    ),
    Part("access", IDENTIFIER, True, r"AKIA[A-Z0-9]+", 0, 20),
    Part("hex", SECRET, True, r"[0-9a-f]{24,}", 0, 24),
    Part(
        "account", IDENTIFIER, False,
        r"""\b((?i:user_?name|user|login|account|client_id|access_key_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3,
    ),
    Part(
        "phrase", SECRET, False,
        r"""\b((?i:pwd|pass|passphrase|pin|auth|credential|signature|private_key|access_key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 4,
    ),
    Part(
        "endpoint", ENDPOINT, False,
        r"""\b((?i:[a-z][a-z0-9+]*://|(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?))([A-Za-z0-9@:%._/?&=-]+)""", 2, 4,
    ),
)


def _found(part: Part, text: Column, matches: Column) -> Column:
    """For each match of a part: the code points before it since the last one, its length, whether it counts."""
    gaps = F.slice(F.transform(F.split(text, part.pattern), F.length), F.lit(1), F.size(matches))
    return F.when(
        F.size(matches) > 0,
        F.zip_with(
            gaps,
            matches,
            lambda gap, match: F.struct(
                gap.alias("gap"),
                F.length(match).alias("length"),
                (F.length(F.regexp_extract(match, part.pattern, part.group)) >= part.least).alias("counts"),
            ),
        ),
    )


def parts(rows: DataFrame) -> DataFrame:
    """row, kind (place in PARTS), start, end of the parts that count, from rows (row, found)."""
    each = rows.select("row", F.posexplode("found").alias("kind", "matches")).where(F.col("matches").isNotNull())
    each = each.select("row", "kind", F.posexplode("matches").alias("place", "m"))
    before = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(before)
    each = each.select("row", "kind", end.alias("end"), "m.length", "m.counts")
    return each.where("counts").select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def linked_weak_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak rows of `found` that start within `scope` of a complementary part of their row."""

    def of(*chosen: str) -> Column:
        return F.col("kind").isin([i for i, p in enumerate(PARTS) if p.role in chosen])

    cell = F.floor(F.col("start") / scope)
    secrets = found.where(of(SECRET)).select(
        "row", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), F.struct("kind", "start", "end").alias("s")
    )
    others = found.where(of(IDENTIFIER, ENDPOINT)).select(
        "row", cell.alias("cell"), F.struct("kind", "start", "end").alias("o")
    )
    pairs = secrets.join(others, ["row", "cell"]).where(F.abs(F.col("s.start") - F.col("o.start")) <= scope)
    weak = [i for i, p in enumerate(PARTS) if not p.base]
    both = pairs.select("row", F.explode(F.array("s", "o")).alias("p")).select("row", "p.*")
    return both.where(F.col("kind").isin(weak)).distinct()


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id and spans, an array of (start, place, kind, end), ordered.

    Positions count code points, end exclusive; place is the kind's place in PARTS. Null and empty texts have
    no spans. Matches of a kind are leftmost and do not overlap; a match that is too short is dropped but has
    used up its text. Ids may be null or repeat, as rows are told apart by themselves; other columns are ignored; an empty
    table gives none. Within a scope of a text there are few parts, as each takes some of its characters, so the join makes few pairs.
    """
    names = [f"m{i}" for i in range(len(PARTS))]
    plain = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    matched = plain.select(
        "*", *(F.regexp_extract_all("text", F.lit(p.pattern), 0).alias(n) for p, n in zip(PARTS, names, strict=True))
    )
    found = F.array(*(_found(p, F.col("text"), F.col(n)) for p, n in zip(PARTS, names, strict=True)))
    rows = stash(matched.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found")))
    every = stash(parts(rows))
    base = every.where(F.col("kind").isin([i for i, p in enumerate(PARTS) if p.base]))
    kinds = F.array(*(F.lit(p.kind) for p in PARTS))
    spans = (
        base.unionByName(linked_weak_parts(every, scope))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("place"), "end"))).alias("spans"))
        .select(
            "row",
            F.transform(
                "spans",
                lambda x: F.struct(
                    x["start"].alias("start"), x["place"].alias("place"), F.get(kinds, x["place"]).alias("kind"), x["end"].alias("end")
                ),
            ).alias("spans"),
        )
    )
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
