"""The per-category attribute whitelist as expressions over a map<string,string>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from listforge import fixed_values as fv
from listforge.functions import classify as cl, dates as dt, money as mo, text as tx

SPARK_TYPES = {"string": T.StringType(), "int": T.LongType(), "year": T.IntegerType(), "float": T.DoubleType(),
               "bool": T.BooleanType(), "date": T.StringType(), "datetime": T.StringType(), "salary": T.DoubleType(),
               "list_string": T.ArrayType(T.StringType()), "enum": T.StringType()}


def kind_of(spec: str | list[str]) -> str:
    return "enum" if isinstance(spec, list) else spec


def typed_schema(category: str) -> T.StructType:
    """One typed nested struct per category."""
    return T.StructType([T.StructField(name, SPARK_TYPES[kind_of(spec)])
                         for name, spec in fv.CATEGORY_ATTRIBUTES[category].items()])


def attribute_key(c: Column) -> Column:
    """Canonical attribute key, or null for a forbidden or empty one."""
    key = F.lower(tx.strip_spaces(c))
    return tx.let(key, lambda k: F.when((k != "") & ~tx.one_of(k, fv.FORBIDDEN_ATTRIBUTES), F.coalesce(
        F.try_element_at(tx.lookup_table(fv.ATTRIBUTE_ALIASES), k), k)))


def last_entries(entries: Column) -> Column:
    """Of array<struct<key, value>> keep, per key, the last entry (at the place of the last one)."""
    def keep(all_entries: Column) -> Column:
        keys = F.reverse(F.transform(all_entries, lambda e: e["key"]))
        n = F.size(all_entries)
        return F.filter(all_entries, lambda e, i: i == n - F.array_position(keys, e["key"]))

    return tx.let(entries, keep)


def spellings(attributes: Column, category: str) -> Column:
    """Raw attribute map -> entries under canonical whitelisted keys, every spelling of a key, in order."""
    allowed = list(fv.CATEGORY_ATTRIBUTES[category])
    renamed = F.transform(F.map_entries(attributes), lambda e: F.struct(
        attribute_key(e["key"]).alias("key"), e["value"].alias("value")))
    return F.filter(renamed, lambda e: tx.one_of(e["key"], allowed) & e["value"].isNotNull())


def whitelist(attributes: Column, category: str) -> Column:
    """Raw attribute map -> map with canonical whitelisted keys; a later spelling of a key wins."""
    return F.map_from_entries(last_entries(spellings(attributes, category)))


def string_list(c: Column) -> Column:
    """Split on ; , | and keep the first of every token; null when nothing is left."""
    items = tx.distinct_by_token(F.transform(F.split(c, "[;,|]"), tx.collapse))
    return F.when(F.size(items) > 0, items)


@tx.bound
def salary_number(value: Column) -> Column:
    """Positive salary of a map value: a stored number is taken as it is ('9412.188'), any other
    text ('R$ 5.000 a 7.000', '5.000') gives its first positive amount."""
    number = value.rlike(r"^\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$") & ~value.rlike(r"^\d{1,3}(?:\.\d{3})+$")
    direct = value.try_cast("double")
    return F.when(number, F.when(direct > 0, direct)).otherwise(mo.salary_floor(value))


def typed_value(key: str, spec: str | list[str], value: Column) -> Column:
    """Typed expression for one attribute; a text that does not parse becomes null."""
    kind = kind_of(spec)
    if kind == "enum":
        return cl.enum_value(key, value, spec)
    if kind == "salary":
        return salary_number(value)
    return {
        "string": tx.clean_text, "int": mo.parse_int_digits, "year": mo.parse_year, "float": mo.parse_float_br,
        "bool": mo.parse_bool_pt, "date": dt.parse_date_multi, "datetime": dt.parse_datetime_multi,
        "list_string": string_list,
    }[kind](value)


def typed_attributes(attributes: Column, category: str) -> Column:
    """Raw attribute map -> typed struct of the category.

    Of several spellings of a key the last one that parses counts.  A salary type that is not given
    is the first one any salary range tells."""
    def build(entries: Column) -> Column:
        def parsed(key: str, parse) -> Column:
            own = F.filter(entries, lambda e: e["key"] == key)
            return F.filter(F.transform(own, lambda e: parse(e["value"])), lambda v: v.isNotNull())

        fields = []
        for key, spec in fv.CATEGORY_ATTRIBUTES[category].items():
            value = F.try_element_at(parsed(key, lambda v: typed_value(key, spec, v)), F.lit(-1))
            if category == "jobs" and key == "salary_type":
                value = F.coalesce(value, F.try_element_at(parsed("salary_range", mo.salary_period), F.lit(1)))
            fields.append(value.alias(key))
        return F.struct(*fields)

    return tx.let(spellings(attributes, category), build)


def typed_columns(values: dict[str, Column], category: str) -> Column:
    """The typed struct of raw attributes whose names are known when the plan is made: every field is
    built from its own columns, without a map that has to be renamed and searched for each row."""
    spelled: dict[str, list[Column]] = {}
    for name, value in values.items():
        key = name.strip().lower()
        if key and key not in fv.FORBIDDEN_ATTRIBUTES:
            spelled.setdefault(fv.ATTRIBUTE_ALIASES.get(key, key), []).append(value)
    fields = []
    for key, spec in fv.CATEGORY_ATTRIBUTES[category].items():
        parsed = [typed_value(key, spec, v) for v in reversed(spelled.get(key, []))]
        if category == "jobs" and key == "salary_type":
            parsed += [mo.salary_period(v) for v in spelled.get("salary_range", [])]
        value = F.coalesce(*parsed) if parsed else F.lit(None)
        fields.append(value.cast(SPARK_TYPES[kind_of(spec)]).alias(key))
    return F.struct(*fields)


def storage_map(typed: Column, category: str) -> Column:
    """Typed struct -> map<string,string> for storage; absent values have no entry."""
    entries = []
    for key, spec in fv.CATEGORY_ATTRIBUTES[category].items():
        value = typed[key]
        text = F.array_join(value, "; ") if kind_of(spec) == "list_string" else value.cast("string")
        entries.append(F.struct(F.lit(key).alias("key"), text.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def raw_location(attributes: Column) -> Column:
    """Location hint carried by a raw attribute."""
    hits = F.filter(F.map_entries(attributes), lambda e: F.lower(F.trim(e["key"])).isin(fv.RAW_LOCATION_ATTRIBUTES)
                    & (F.trim(e["value"]) != ""))
    return tx.clean_text(F.try_element_at(hits, F.lit(1))["value"])


def raw_location_of(values: dict[str, Column]) -> Column:
    """The same where the names are known: the first that is not blank."""
    hits = [F.when(F.trim(v) != "", v) for k, v in values.items() if k.strip().lower() in fv.RAW_LOCATION_ATTRIBUTES]
    return tx.clean_text(F.coalesce(*hits, F.lit(None).cast("string")))


def salary_sanitize(attributes: Column) -> Column:
    """Without a positive salary drop salary_range and salary_type; drop a type that is not known."""
    floor = salary_number(F.try_element_at(attributes, F.lit("salary_range")))
    kind = mo.salary_type_or_none(F.try_element_at(attributes, F.lit("salary_type")))

    def build(s: Column) -> Column:
        rest = F.map_filter(attributes, lambda k, v: ~k.isin("salary_range", "salary_type"))
        own = F.array(F.struct(F.lit("salary_range").alias("key"), s["floor"].cast("string").alias("value")),
                      F.struct(F.lit("salary_type").alias("key"), s["kind"].alias("value")))
        return F.map_concat(rest, F.map_from_entries(F.filter(
            own, lambda e: s["floor"].isNotNull() & e["value"].isNotNull())))

    return tx.let(F.struct(floor.alias("floor"), kind.alias("kind")), build)


def merge_attributes(old: Column, new: Column) -> Column:
    """Right-biased map union followed by the salary check; no session-wide map policy needed."""
    empty = F.create_map().cast("map<string,string>")
    both = tx.let(F.coalesce(new, empty), lambda n: F.map_concat(
        F.map_filter(F.coalesce(old, empty), lambda k, v: ~F.map_contains_key(n, k)), n))
    return tx.let(both, salary_sanitize)


def legal_basis(fields: Column) -> Column:
    """First non-empty text of the legal-basis keys of a map."""
    return F.coalesce(*[tx.clean_text(F.try_element_at(fields, F.lit(k))) for k in fv.LEGAL_BASIS_KEYS])


def confidential_budget(flag: Column, description: Column) -> Column:
    token = F.trim(tx.match_text(description))
    direct = F.trim(tx.match_text(flag))
    return (F.when(direct.isin("true", "1", "sim", "s", "ativo", "yes"), True)
            .when(direct.isin("false", "0", "nao", "n", "inativo", "no"), False)
            .when(token.isin("sim", "sigiloso", "orcamento sigiloso"), True)
            .when(token.isin("nao", "nao sigiloso", "nao se aplica"), False))


def budget_sources(sources: Column) -> Column:
    n = F.size(F.filter(sources, lambda x: x.isNotNull()))
    return F.when(n > 0, n)


def municipality_code(unit: Column) -> Column:
    """Seven digits under any key that mentions 'ibge'."""
    hits = F.filter(F.transform(F.map_entries(unit), lambda e: F.struct(
        tx.match_text(e["key"]).alias("k"), mo.digits(F.coalesce(e["value"], F.lit(""))).alias("d"))),
        lambda s: s["k"].contains("ibge") & (F.length(s["d"]) == 7))
    return F.try_element_at(hits, F.lit(1))["d"]


def target_ufs(config: Column) -> Column:
    items = F.transform(F.split(F.coalesce(config, F.lit("")), ","), lambda x: F.upper(tx.collapse(x)))
    return F.array_distinct(F.filter(items, lambda x: x.isin(fv.UFS)))


def target_codes(config: Column) -> Column:
    items = F.transform(F.split(F.coalesce(config, F.lit("")), ","), mo.digits)
    return F.array_distinct(F.filter(items, lambda x: F.length(x) == 7))


def scope_date(config: Column, default: str) -> Column:
    d = mo.digits(F.coalesce(config, F.lit("")))
    return F.when(F.length(d) == 8, d).otherwise(F.lit(default))


def feature_list(items: Column, flag: str | None = None, keys: tuple[str, ...] = ("name", "label", "value", "description"),
                 lower: bool = False) -> Column:
    """Names out of array<map>: with a flag only the entries whose flag is SIM; distinct, in order."""
    if flag:
        items = F.filter(items, lambda e: tx.clean_text(F.try_element_at(e, F.lit(flag))) == "SIM")
    names = F.transform(items, lambda e: F.coalesce(*[tx.clean_text(F.try_element_at(e, F.lit(k))) for k in keys]))
    if lower:
        names = F.transform(names, lambda x: F.lower(x))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))
