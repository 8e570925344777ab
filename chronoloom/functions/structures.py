"""JSON, maps, arrays, identifiers and texts over columns (F15; X7, X11, X13, X15 to X17, X42 to X44, X46 to X52; K2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet of short identifiers (fixed value).
SHORT = "123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"


def lower_email(c: Column) -> Column:  # X7
    return F.lower(F.trim(c))


def json_equal(a: Column, b: Column) -> Column:
    """equality of whole documents, whatever their spacing and order of keys; false for texts that are no JSON."""
    canon = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce(canon(a) == canon(b), F.lit(False))


def json_get(c: Column, path: str, kind: str = "string") -> Column:  # X48
    return F.get_json_object(c, path).try_cast(kind)


def tolerant_json(c: Column) -> Column:
    """Is the text JSON?"""
    return F.try_parse_json(c).isNotNull()


def without_key(m: Column, *keys: str) -> Column:  # X47
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def merged(left: Column, right: Column) -> Column:
    """Both maps; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def deep_merged(left: Column, right: Column, fields: tuple[str, ...]) -> Column:
    """A struct with the right one's fields where they are not null, structs field by field one level down."""
    return F.struct(*[F.coalesce(right[f], left[f]).alias(f) for f in fields])


def entries(m: Column) -> Column:  # X51: sorted by key
    return F.array_sort(F.map_entries(m))


def leading_int(c: Column) -> Column:
    """The integer that a text begins with, null without one."""
    return F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def strip_prefix(c: Column, prefix: str) -> Column:  # X16
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def metadata_key(c: Column) -> Column:
    """The name in 'metadata[name]', null for other texts."""
    return F.nullif(F.regexp_extract(c, r"^metadata\[(.*)\]$", 1), F.lit(""))


def hours(seconds: Column) -> Column:  # X42
    return seconds / 60 / 60


def whole_and_rest(n: Column, by: int) -> Column:  # X43
    return F.struct(F.floor(n / by).cast("long").alias("whole"), (n % by).alias("rest"))


def random_token(n: int = 32) -> Column:
    """2n random hexadecimal digits; other ones in every run."""
    return F.lower(F.hex(F.substring(F.concat(F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))), F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))), 1, n)))


def short_id(uuid: Column) -> Column:
    """A UUID in the short alphabet, 22 digits, by long division of its 128 bits in exact decimals (no UDF)."""
    digits = F.replace(uuid, F.lit("-"), F.lit(""))
    base, step = len(SHORT), 58**5

    # the number as 8 limbs of 16 bits; each pass divides by 58**5 and gives 5 digits
    limbs = F.array(*[F.conv(F.substring(digits, 4 * i + 1, 4), 16, 10).cast("long") for i in range(8)])
    zero = F.struct(F.array().cast("array<bigint>").alias("q"), F.lit(0).cast("long").alias("r"))

    def divide(a, limb):
        n = a["r"] * 65536 + limb
        return F.struct(F.concat(a["q"], F.array(F.floor(n / step).cast("long"))).alias("q"), (n % step).alias("r"))

    def block(state, _):
        d = F.aggregate(state["n"], zero, divide)
        five = F.concat(*[F.substr(F.lit(SHORT), (F.floor(d["r"] / base**i) % base + 1).cast("int"), F.lit(1)) for i in (4, 3, 2, 1, 0)])
        return F.struct(d["q"].alias("n"), F.concat(five, state["t"]).alias("t"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.struct(limbs.alias("n"), F.lit("").alias("t")), block)
    return F.right(out["t"], F.lit(22))


def description(what: Column, when: Column, who: Column, where: Column, notes: Column) -> Column:
    """X11: the parts that are there, each under its heading. who: array of names."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:\n"), c))
    return F.concat_ws("\n\n", part("What", what), part("When", when), part("Who", F.array_join(who, "\n")), part("Where", where), part("Notes", notes))


def payload_json(trigger: Column, created: Column, payload: Column) -> Column:
    """K2: the default body of a delivery."""
    return F.to_json(F.struct(trigger.alias("triggerEvent"), created.alias("createdAt"), payload.alias("payload")))


def content_type(template: Column) -> Column:
    """K2: that of a rendered template, or of the default body where there is none."""
    return F.when(template.isNull() | tolerant_json(template), "application/json").otherwise("application/x-www-form-urlencoded")


def query_parameters(url: Column) -> Column:
    """The parameters of a URL as a map."""
    rest = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.str_to_map(rest, F.lit("&"), F.lit("="))
