"""Tenant and tag predicates. Null tags are empty tags; every predicate is two-valued."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("any", "all", "any_strict", "all_strict", "exact")
DEFAULT_BANK = "default-team"
MAX_DEPTH, MAX_CHILDREN = 12, 64


def tag_set(col: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(col, F.array().cast("array<string>")), lambda x: x.isNotNull()))


@dataclass(frozen=True)
class TagFilter:
    """any / all accept rows without tags; the strict modes do not; exact compares the sets."""

    tags: tuple[str, ...] = ()
    mode: str = "any"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown tag mode {self.mode}")

    def predicate(self, col: Column) -> Column:
        have = tag_set(col)
        want = F.array(*map(F.lit, dict.fromkeys(self.tags))).cast("array<string>")
        overlap = F.arrays_overlap(have, want) if self.tags else F.lit(False)
        covers = F.size(F.array_except(want, have)) == 0
        bare = F.size(have) == 0
        return {
            "any": bare | overlap,
            "all": bare | covers,
            "any_strict": overlap,
            "all_strict": covers & ~bare,
            "exact": covers & (F.size(F.array_except(have, want)) == 0),
        }[self.mode]


@dataclass(frozen=True)
class TagGroup:
    """and / or / not over filters and groups."""

    op: str
    children: tuple = ()

    def predicate(self, col: Column, depth: int = 1) -> Column:
        if depth > MAX_DEPTH or not 1 <= len(self.children) <= MAX_CHILDREN or (self.op == "not" and len(self.children) != 1):
            raise ValueError("tag group is too deep, empty, or too wide")
        parts = [c.predicate(col, depth + 1) if isinstance(c, TagGroup) else c.predicate(col) for c in self.children]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if self.op == "and" else out | p
        return ~out if self.op == "not" else out


def is_absent(rule: TagFilter | TagGroup | None) -> bool:
    """No filter at all: none given, or no tags in any mode but exact."""
    return rule is None or (isinstance(rule, TagFilter) and not rule.tags and rule.mode != "exact")


@dataclass(frozen=True)
class MemoryScope:
    """A trusted scope; ``narrow`` can only restrict it."""

    bank_id: str = DEFAULT_BANK
    visibility: TagFilter | TagGroup | None = None
    narrowed: tuple = field(default=())

    def narrow(self, rule: TagFilter | TagGroup | None) -> "MemoryScope":
        return self if is_absent(rule) else MemoryScope(self.bank_id, self.visibility, (*self.narrowed, rule))

    def predicate(self, bank: Column, tags: Column) -> Column:
        out = F.coalesce(bank == self.bank_id, F.lit(False))
        for rule in (self.visibility, *self.narrowed):
            if not is_absent(rule):
                out = out & rule.predicate(tags)
        return out


def visible(df: DataFrame, scope: MemoryScope, bank: str = "bank_id", tags: str = "tags") -> DataFrame:
    """Rows in scope. The bank equality reaches the scan; tag sets are filtered above it."""
    return df.where(scope.predicate(F.col(bank), F.col(tags)))


def public_documents(docs: DataFrame, scope: MemoryScope) -> DataFrame:
    """Current documents in scope, conversations hidden."""
    return visible(docs.where(~F.col("file_type").isin("conversation")), scope)


def memory_in_scope(units: DataFrame, documents: DataFrame, scope: MemoryScope) -> DataFrame:
    """Memory rows in scope by their own tags and by a visible document."""
    return visible(units, scope, tags="scope_tags").join(visible(documents, scope).select("document_id"), "document_id", "left_semi")


def resolve_token(bindings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Bank of each token by its SHA-256; unknown tokens have none (closed by default)."""
    return tokens.select("token", F.sha2("token", 256).alias("token_sha256")).join(bindings, "token_sha256", "left").select("token", "bank_id")


def recall_sources(units: DataFrame, documents: DataFrame, completed: DataFrame, *, include_stale: bool = False, source_types=(), memory_types=(), tags=None, reference_time=None) -> DataFrame:
    """Units that recall may use: of current documents, conversations only when completed, by state, type, tags and time."""
    done = completed.where("status = 'completed'").select("document_id").distinct().withColumn("done", F.lit(True))
    docs = documents.where("is_current").select("document_id", "file_type").join(done, "document_id", "left").where((F.col("file_type") != "conversation") | F.col("done")).select("document_id")
    rule = F.col("state").isin("active", "stale") if include_stale else F.col("state") == "active"
    if source_types:
        rule = rule & (F.coalesce(F.col("source_type").isin(*source_types), F.lit(False)) | F.coalesce(F.arrays_overlap("source_types", F.array(*map(F.lit, source_types))), F.lit(False)))
    if memory_types:
        rule = rule & F.col("memory_type").isin(*memory_types)
    if not is_absent(tags):
        rule = rule & tags.predicate(F.col("tags"))
    if reference_time is not None:
        rule = rule & (F.col("mentioned_at") <= F.lit(reference_time))
    return units.where(rule).join(docs, "document_id", "left_semi")
