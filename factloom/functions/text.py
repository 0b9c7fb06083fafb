"""Scalar functions over identifiers, paths, levels and text, as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.conventions import LANGUAGES

#: Log levels that are kept as they are (fixed values); ``warning`` is ``warn``, anything else ``unknown``.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")
#: Names whose values are never shown.
SECRETS = ("password", "token", "secret", "authorization", "apikey", "api_key")


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix_`` and 24 hexadecimal digits of the SHA-256 of the parts joined by ``::``; a null part counts as empty."""
    safe = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("::", *safe), 256), 1, 24))


def glob_regex(glob: str) -> str:
    """``**`` crosses slashes, ``*`` doesn't, ``?`` stays what it is in a regular expression; everything else stands for itself."""
    out = []
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out.append({"**": ".*", "*": "[^/]*", "?": "?"}.get(part) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", part))
    return "^" + "".join(out) + "$"


def expanded(glob: str) -> list[str]:
    """A glob without braces for each choice that its braces leave."""
    found = re.search(r"\{([^{}]*)\}", glob)
    return [x for choice in found[1].split(",") for x in expanded(glob[: found.start()] + choice + glob[found.end() :])] if found else [glob]


def listing_regex(globs: tuple[str, ...]) -> str:
    """For finding files, where braces are choices and a leading ``**/`` stands for no folder too."""
    bodies = [glob_regex(x.removeprefix("**/"))[1:-1] for g in globs for x in expanded(g)]
    return "^(?:.*/)?(?:" + "|".join(bodies) + ")$"


def any_glob(globs: tuple[str, ...]) -> str:
    """One pattern for all of the globs; braces stand for themselves."""
    return "|".join(map(glob_regex, globs))


def holds(value: Column, *words: str) -> Column:
    """Whether any of the words is in ``value``; a scan of bytes, which costs a small part of a pattern's."""
    return reduce(or_, (F.contains(value, F.lit(w)) for w in words), F.lit(False))


def meets(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether ``path`` meets any of the globs as in :func:`any_glob`; the patterns are tried only where the longest fixed part of one is."""
    fixed = dict.fromkeys(max(re.split(r"\*+|[^*]?\?", g), key=len) for g in globs)
    return holds(path, *fixed) & path.rlike(any_glob(globs))


def normal_path(path: Column) -> Column:
    """Forward slashes, without ``.``, ``..`` and empty segments."""
    segments = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(folded, "/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def relative(path: Column, root: Column) -> Column:
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def reference_key(path: Column) -> Column:
    """The key under which a module is looked up: no extension, dots and colons as slashes, one slash at a time, lower case."""
    bare = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[.:]+", "/"), "/+", "/"), "^/|/$", ""))


def suffixes(path: Column) -> Column:
    """Every run of segments that ends the path, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(F.size(a), F.size(b)).cast("bigint"))


def language(path: Column) -> Column:
    ext = extension(path)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.nullif(ext, F.lit("")), F.lit("unknown"))


def level(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low == "warning", "warn").when(low.isin(*LEVELS), low).otherwise("unknown")


def truncated(value: Column, most: int, mark: str = "") -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - len(mark)), F.lit(mark))).otherwise(value)


def redacted(values: Column, names: tuple[str, ...] = SECRETS) -> Column:
    """A map with the values of secret keys hidden."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*names), F.lit("[redacted]")).otherwise(v))


def token_estimate(value: Column) -> Column:
    return F.ceil(F.length(value) / F.lit(3.5)).cast("bigint")


def search_words(query: Column) -> Column:
    """Distinct search words, in order, as typed."""
    return F.array_distinct(F.filter(F.split(query, r"[\s(),:{}\[\]]+"), lambda x: x != ""))


def words(query: str) -> list[str]:
    """Distinct search words of a query, in order, as typed."""
    return list(dict.fromkeys(w for w in re.split(r"[\s(),:{}\[\]]+", query) if w))


#: Common Latin letters with diacritics, and without (fixed values).
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(value: Column) -> Column:
    """Lower case without the common Latin diacritics."""
    return F.translate(F.lower(value), ACCENTED, PLAIN)


def index_tokens(value: Column) -> Column:
    """Tokens of a text index: folded, split at everything that is neither letter nor digit."""
    return F.filter(F.split(folded(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


#: Stands after the end of a text, so that its last characters begin trigrams too.
END = "\u0001\u0001"


def trigrams(value: Column) -> Column:
    """Three characters from each place of the lower-cased text on."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.transform(F.filter(F.sequence(F.lit(0), F.length(low)), lambda i: i > 0), lambda i: F.substring(F.concat(low, F.lit(END)), i, F.lit(3)))
