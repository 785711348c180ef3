"""Column functions over text: cleaning, normal forms, tokens and ids."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stopwords that lexical tokens leave out.
STOPWORDS = """
a about above after again against ain all am an and any are aren aren't as at
be because been before being below between both but by can couldn couldn't d
did didn didn't do does doesn doesn't doing don don't down during each few
for from further had hadn hadn't has hasn hasn't have haven haven't having he
he'd he'll her here hers herself he's him himself his how i i'd if i'll i'm
in into is isn isn't it it'd it'll it's its itself i've just ll m ma me
mightn mightn't more most mustn mustn't my myself needn needn't no nor not
now o of off on once only or other our ours ourselves out over own re s same
shan shan't she she'd she'll she's should shouldn shouldn't should've so some
such t than that that'll the their theirs them themselves then there these
they they'd they'll they're they've this those through to too under until up
ve very was wasn wasn't we we'd we'll we're were weren weren't we've what
when where which while who whom why will with won won't wouldn wouldn't y
you you'd you'll your you're yours yourself yourselves you've
""".split()


def clean(c: Column) -> Column:
    """Text without outer white space of any kind; null becomes empty."""
    return F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


@cache
def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that fold to one other character, those, and the characters that fold to several, by Unicode's full case folding."""
    folded = [(c, f) for c in map(chr, range(0x110000)) if (f := c.casefold()) != c]
    one = [(c, f) for c, f in folded if len(f) == 1]
    return "".join(c for c, _ in one), "".join(f for _, f in one), [(c, f) for c, f in folded if len(f) > 1]


def casefold(c: Column) -> Column:
    """Text under Unicode's full case folding: sharp s and ligatures unfold, a final sigma becomes a sigma."""
    single, into, several = _foldings()
    pairs = F.array(*[F.struct(F.lit(x).alias("c"), F.lit(y).alias("f")) for x, y in several])
    unfolded = F.aggregate(pairs, c, lambda text, p: F.replace(text, p["c"], p["f"]))
    any_of = "[" + "".join(x for x, _ in several) + "]"
    return F.translate(F.when(c.rlike(any_of), unfolded).otherwise(c), single, into)


def normal_form(c: Column) -> Column:
    """Case-folded, runs of white space as one space, trimmed; null becomes empty."""
    return clean(F.regexp_replace(casefold(c), r"(?U)\s+", " "))


def lowered_form(c: Column) -> Column:
    """Lower-cased, runs of white space as one space, trimmed; null becomes empty. Texts of one such form have the same terms, which holds
    for no wider folding: a sharp s parts words and two letters s don't."""
    return clean(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def terms(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def lexical_terms(c: Column) -> Column:
    """Distinct terms of two letters or more that are no stopwords, in order of the alphabet."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_sort(F.array_except(F.array_distinct(F.filter(terms(c), lambda x: F.length(x) > 1)), stop))


def rough_tokens(c: Column) -> Column:
    """Number of runs of ASCII letters, digits and underscores."""
    return F.size(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))


def words(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def falsy_or(c: Column, other: Column) -> Column:
    """The first unless it is null or empty."""
    return F.when(c.isNull() | (c == ""), other).otherwise(c)


def first_nonempty(answers: Column) -> Column:
    """The first answer that isn't blank, trimmed; else empty."""
    return F.coalesce(F.get(F.filter(F.transform(answers, clean), lambda x: x != ""), 0), F.lit(""))


def first_or_empty(answers: Column) -> Column:
    """The first answer as it stands, blank or not; empty for an empty or null list and for a null."""
    return F.coalesce(F.get(answers, 0), F.lit(""))


def sample_id(split: Column, conv_id: Column, turn_id: Column) -> Column:
    """split:conv:turn; a null part reads None."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("None")) for p in (split, conv_id, turn_id)])


def hashed_id(*parts: Column) -> Column:
    """sha256 of the parts joined by null characters; null parts count as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def docid_list(c: Column) -> Column:
    """Ids of a comma- or space-separated text, or of a bracketed and quoted list; null gives none."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]'\",]", " ")
    return F.filter(F.split(plain, " +"), lambda x: x != "")


def base_passage(c: Column) -> Column:
    """A passage id without its `_p<number>` ending."""
    return F.regexp_replace(c, r"/?_p\d+$", "")


def long_or_null(name: str) -> Column:
    """A column as whole numbers; what isn't one becomes null."""
    return F.expr(f"try_cast(`{name}` as bigint)")


def bin_of(c: Column, bounds: dict[str, tuple[int, int | None]]) -> Column:
    """The label of the first inclusive range that holds the value; null where none does."""
    out = None
    for label, (low, high) in bounds.items():
        inside = (c >= low) if high is None else c.between(low, high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


# History-depth bins, inclusive; the last is open.
DEPTH_BINS = {"d00": (0, 0), "d01": (1, 1), "d02_04": (2, 4), "d05_06": (5, 6), "d07_08": (7, 8), "d09_10": (9, 10), "d11_14": (11, 14), "d15_plus": (15, None)}


def is_passage_part(c: Column) -> Column:
    """Whether an id ends in `_p<number>`."""
    return c.rlike(r"_p\d+$")


def chosen_places(n: Column, keep: Column, *seed: Column) -> Column:
    """`keep` of the places 0 to n - 1, in order: those of the least digests of the seed and the place."""
    salt = F.concat_ws(":", *[s.cast("string") for s in seed])
    keyed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.md5(F.concat(salt, F.lit(":"), i.cast("string"))).alias("h"), i.alias("i")))
    picked = F.transform(F.slice(F.array_sort(keyed), F.lit(1), F.least(keep, n)), lambda x: x["i"])
    return F.when(n > 0, F.array_sort(picked)).otherwise(F.array().cast("array<int>"))


def byte_size(c: Column) -> Column:
    """A size for people: whole bytes, else one decimal of the largest unit up to TB that it reaches; null reads unknown."""
    out = F.concat(F.format_string("%.1f", F.bround(c / 1024.0**4, 1)), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(c < 1024 ** (power + 1), F.concat(F.format_string("%.1f", F.bround(c / 1024.0**power, 1)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(c.isNull(), "unknown").when(c < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def packed_ints(c: Column) -> Column:
    """A list of whole numbers as little-endian 32-bit integers."""
    each = F.transform(c, lambda x: F.concat(*[F.lpad(F.hex(F.shiftright(x.cast("int"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))
    return F.unhex(F.array_join(each, ""))


def unpacked_ints(c: Column) -> Column:
    """The list that packed_ints packed."""
    byte = lambda at: F.conv(F.hex(F.substring(c, at, F.lit(1))), 16, 10).cast("long")
    value = lambda i: reduce(lambda a, b: a + b, [F.shiftleft(byte(i * 4 + k + 1), 8 * k) for k in range(4)])
    signed = lambda v: F.when(v >= 2**31, v - 2**32).otherwise(v).cast("int")
    size = F.floor(F.octet_length(c) / 4).cast("int")
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: signed(value(i)))).otherwise(F.array().cast("array<int>"))


def entities(c: Column) -> Column:
    """A stand-in for an entity recogniser: the distinct lexical terms of eight letters or more."""
    return F.filter(lexical_terms(c), lambda x: F.length(x) >= 8)
