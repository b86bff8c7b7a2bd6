"""Entity detection: documents in, span arrays (wide) or one row per span (long) out.

Row-local all through: one scan of the text column gives all types, without a shuffle, in batch and on streams alike.
Null texts have no spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scalar, spans
from ..plans import rules
from ..plans.rules import Bundle, TypeRule

TYPES = ("SN", "SSN", "DN", "PN", "MN", "BN", "AN", "EML", "IP")


def detect_type(text: Column, rule: TypeRule, limit: int | None = None) -> Column:
    """Spans of one type before any filter that looks at other types."""
    if rule.longest:
        found = spans.scan_longest(text, list(rule.longest), rule.pattern, rule.max_len, limit, rule.needs)
    else:
        found = spans.scan(text, rule.pattern, rule.max_len, limit, rule.needs)
    if rule.trim:
        cut = lambda x: spans.span(x["start"], x["start"] + F.length(scalar.trim_address(x["matchString"])), scalar.trim_address(x["matchString"]))
        found = F.transform(found, cut)
    if rule.min_len:
        found = F.filter(found, lambda x: F.length(x["matchString"]) >= rule.min_len)
    return found


def valid_numbers(found: Column, valid: bool = True) -> Column:
    """Resident numbers whose check digit holds, or those whose doesn't though their date is one."""
    if valid:
        return F.filter(found, lambda x: scalar.rrn_checksum(x["matchString"]))
    return F.filter(found, lambda x: ~scalar.rrn_checksum(x["matchString"]) & scalar.rrn_structure(x["matchString"]))


def filter_phones(found: Column, text: Column, rule: TypeRule, others: list[Column]) -> Column:
    post = rule.postfilter
    if post.get("boundary_digit_reject", True):
        found = spans.no_digit_beside(found, text)
    low, high = post.get("intl_digits_length", {}).get("min", 8), post.get("intl_digits_length", {}).get("max", 15)
    digits = lambda x: F.length(scalar.digits_only(x["matchString"]))
    found = F.filter(found, lambda x: scalar.phone_structure(x["matchString"]) & (~x["matchString"].startswith("+") | digits(x).between(low, high)))
    return spans.finalized(spans.without_overlap(found, others))


def filter_accounts(found: Column, text: Column, rule: TypeRule, others: list[Column], phone: str | None = None) -> Column:
    post = rule.postfilter
    if post.get("boundary_digit_reject", True):
        found = spans.no_digit_beside(found, text)
    low, high = post.get("digits_length", {}).get("min", 1), post.get("digits_length", {}).get("max", 99)
    found = F.filter(found, lambda x: F.length(scalar.digits_only(x["matchString"])).between(low, high))
    if phone and post.get("reject_if_phone_like"):
        found = F.filter(found, lambda x: ~F.trim(x["matchString"]).rlike(f"^(?:{phone})$"))
    return spans.finalized(spans.without_overlap(found, others))


def structure_valid(key: str, match: Column) -> Column:
    """The structure test of a type; true for those that have none."""
    tests = {"SN": scalar.rrn_structure, "SSN": scalar.ssn_structure, "EML": scalar.email_structure, "IP": scalar.ip_structure, "MN": scalar.phone_structure}
    return tests[key](match) if key in tests else F.lit(True)


def with_structure(found: Column, key: str) -> Column:
    return F.filter(found, lambda x: structure_valid(key, x["matchString"]))


def typed(found: Column, key: str) -> Column:
    """Spans as struct<type, start, end, matchString>."""
    return F.transform(found, lambda x: F.struct(F.lit(key).alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["matchString"].alias("matchString")))


def _scanned(df: DataFrame, bundle: Bundle, keys: list[str], text: Column, limit: int, out: dict[str, str], prefix: str, include_invalid: bool, strict_structure: bool) -> DataFrame:
    """`df` with the columns of neighbouring scan steps, and their names in `out`."""
    df = df.withColumns({f"{prefix}{k}": detect_type(text, bundle.types[k], limit) for k in keys})
    out |= {k: f"{prefix}{k}" for k in keys}
    checked: dict[str, Column] = {}
    for key in (k for k in keys if bundle.types[k].checksum):
        if include_invalid:
            out[f"{key}_INVALID"] = f"{prefix}{key}_INVALID"
            checked[out[f"{key}_INVALID"]] = valid_numbers(F.col(out[key]), False)
        checked[out[key]] = valid_numbers(F.col(out[key]))
    df = df.withColumns(checked) if checked else df
    return df.withColumns({out[k]: with_structure(F.col(out[k]), k) for k in keys}) if strict_structure else df


Step = Callable[[DataFrame, Column, dict[str, str]], DataFrame]


def detect(df: DataFrame, ruleset: str | Bundle = "default", text_col: str = "text", limit: int | None = None, include_invalid: bool = False, strict_structure: bool = False, normalize: bool = True, prefix: str = "", custom: dict[str, Step] | None = None) -> DataFrame:
    """`df` with one span-array column per type of the ruleset (named `prefix` + type), before the context filter.

    The ruleset's steps run in their order: a filter sees the types scanned before it. `custom` has further steps by name,
    each a function of (df, text, columns by type) that returns `df` with columns added or replaced and puts new types into
    the mapping; names that nobody knows are passed over. Zero-width characters are ignored, offsets are those of the source. `include_invalid` adds SN_INVALID, which then keeps
    phones and accounts from those spans. `strict_structure` drops spans that fail the type's structure test. Columns of
    `df` that are named like a type are replaced; a `prefix` keeps them.
    """
    bundle = ruleset if isinstance(ruleset, Bundle) else rules.load(ruleset)
    limit = bundle.limit if limit is None else limit
    source, plain = F.col(text_col), f"{prefix}plain_text_of_{text_col}"
    df = df.withColumn(plain, F.coalesce(scalar.strip_zero_width(source) if normalize else source, F.lit("")))
    text, out, waiting, custom = F.col(plain), {}, [], custom or {}
    filters = {"post_mn": ("MN", filter_phones), "post_bn": ("BN", filter_accounts)}
    for step in [*bundle.steps, None]:
        if step in bundle.types and step not in custom:
            waiting.append(step)
            continue
        if waiting and (step is None or step in filters or step in custom):
            df, waiting = _scanned(df, bundle, waiting, text, limit, out, prefix, include_invalid, strict_structure), []
        if step in custom:
            df = custom[step](df, text, out)
        elif step in filters and filters[step][0] in out:
            key, kept = filters[step]
            others = [F.col(out[k]) for k in bundle.types[key].postfilter.get("reject_overlap_with", []) if k in out]
            df = df.withColumn(out[key], kept(F.col(out[key]), text, bundle.types[key], others))
    if normalize:
        odd = source.rlike(f"[{scalar.ZERO_WIDTH}]")
        kept = spans.kept_positions(source, scalar.ZERO_WIDTH)
        df = df.withColumns({c: F.when(odd & (F.size(c) > 0), spans.remap(F.col(c), source, kept)).otherwise(F.col(c)) for c in out.values()})
    return df.drop(plain)


#: Fixed value: one example of each type but accounts.
SELF_TEST = "SN=900101-1234567 DN=11-22-333333-44 PN=M12345678 MN=010-1234-5678 SSN=123-45-6789 EML=test.user+aa@company.co.kr IP=192.168.0.10 AN=서울특별시 강남구 테헤란로 123-4"


def with_meta(df: DataFrame, bundle: Bundle) -> DataFrame:
    """`df` with the ruleset's name, version and time."""
    return df.withColumns({"ruleset_name": F.lit(bundle.name), "ruleset_version": F.lit(bundle.version), "ruleset_updated_at": F.lit(bundle.updated_at)})


def long_form(df: DataFrame, id_cols: list[str], types: list[str], prefix: str = "") -> DataFrame:
    """One row per span: ids, type, start, end, matchString."""
    pieces = F.concat(*[typed(F.col(f"{prefix}{k}"), k) for k in types])
    return df.select(*id_cols, F.inline(pieces))


def detect_spans(df: DataFrame, id_cols: list[str], ruleset: str | Bundle = "default", **options) -> DataFrame:
    """`detect` in long form."""
    bundle = ruleset if isinstance(ruleset, Bundle) else rules.load(ruleset)
    found = detect(df, bundle, prefix="found_", **options)
    types = [c.removeprefix("found_") for c in found.columns if c.startswith("found_")]
    return long_form(found, id_cols, types, "found_")


def counts(df: DataFrame, types: list[str], prefix: str = "") -> DataFrame:
    """`df` with TYPE_CNT for each type."""
    return df.withColumns({f"{k}_CNT": F.size(f"{prefix}{k}") for k in types})


def observed(df: DataFrame, name: str, types: list[str], prefix: str = "") -> tuple[DataFrame, Observation]:
    """`df` with a metric of rows and of spans per type, to be read from the observation after an action."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.sum(F.size(f"{prefix}{k}")).alias(k) for k in types]), watch


def context_totals(explained: DataFrame) -> DataFrame:
    """Kept and rejected spans per type, of what the context filter explained."""
    return explained.groupBy("type").agg(F.count_if("context_pass").alias("kept"), F.count_if(~F.col("context_pass")).alias("rejected"))


def prune(df: DataFrame) -> DataFrame:
    """Long-form spans without invalid numbers and spans that the context filter rejected."""
    return df.where((F.col("type") != "SN_INVALID") & ~F.col("type").endswith("_CTX_REJECTED"))


def reject_cleanup(rejected: Column, others: list[Column]) -> Column:
    """Rejected accounts without those that overlap an accepted span of another type."""
    return spans.finalized(spans.without_overlap(F.filter(rejected, lambda x: x["end"] > x["start"]), others))
