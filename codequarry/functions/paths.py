"""Path columns: parts, normal form, safety, sensitivity and filters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.text import bind

# Names and endings that mark a credential file.
SENSITIVE_SUFFIXES = [
    ".pem", ".key", ".id_rsa", ".id_ed25519", ".p12", ".pfx", ".kdbx", ".keystore", ".jks",
]
SENSITIVE_NAMES = [
    "id_rsa", "id_ed25519", "id_dsa", "id_ecdsa", "credentials.json", "secrets.json",
    "service-account.json", "service_account.json", ".htpasswd", ".npmrc", ".pypirc",
    "oauth_credentials.json",
]
SENSITIVE_PATHS = [".kube/config", ".aws/credentials"]

# Fixed value: the module extensions an import may leave out (C11).
MODULE_EXTENSION = r"\.(ts|tsx|js|jsx|mjs|cjs|py)$"


def slashes(path: Column) -> Column:
    """Backslashes to slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension(path: Column) -> Column:
    """Last extension with its dot; empty for none and for dot-files."""
    def of_name(base: Column) -> Column:
        tail = F.call_function("substring_index", base, F.lit("."), F.lit(-1))
        return F.when(F.length(tail) < F.length(base) - 1, F.concat(F.lit("."), tail)).when(base.isNotNull(), F.lit(""))

    return bind(basename(path), of_name)


def basename(path: Column) -> Column:
    """C3."""
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent directory, ``.`` at the root."""
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit("."))


def components(path: Column) -> Column:
    return F.split(path, "/", -1)


def depth(path: Column) -> Column:
    """Number of components minus one."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def order_key(path: Column) -> Column:
    """A string that sorts as the components of a path do: NUL ends a component, and what sorts next to NUL is escaped."""
    escaped = F.replace(F.replace(path, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.replace(escaped, F.lit("/"), F.lit("\x00"))


def from_order_key(key: Column) -> Column:
    """The path that has this :func:`order_key`."""
    escaped = F.replace(key, F.lit("\x00"), F.lit("/"))
    return F.replace(F.replace(escaped, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def ancestors(path: Column) -> Column:
    """H1: every proper ancestor directory of a path, outermost first."""
    return F.when(depth(path) > 0, F.transform(
        F.sequence(F.lit(1), depth(path)), lambda i: F.call_function("substring_index", path, F.lit("/"), i)
    )).otherwise(F.array().cast("array<string>"))


def path_suffixes(path: Column) -> Column:
    """The path and every tail of it that starts after a slash, shortest first."""
    return F.transform(
        F.sequence(F.lit(1), depth(path) + 1), lambda i: F.call_function("substring_index", path, F.lit("/"), -i)
    )


def normalize(path: Column) -> Column:
    """Fold ``.``, ``..`` and doubled slashes of a relative path.

    A trailing slash survives, an empty result becomes ``.``.
    """
    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        climbs = (part == "..") & (F.size(acc) > 0) & (last != "..")
        return (
            F.when(part.isin("", "."), acc)
            .when(climbs, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.array_append(acc, part))
        )

    def fold(whole: Column) -> Column:
        folded = F.aggregate(F.call_function("split", whole, F.lit("/"), F.lit(-1)), F.array().cast("array<string>"), step)
        tail = F.when(F.endswith(whole, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
        return F.concat(bind(F.array_join(folded, "/"), lambda p: F.when(p == "", F.lit(".")).otherwise(p)), tail)

    return bind(path, fold)


def escapes_root(path: Column) -> Column:
    """Absolute, or climbing above the root once normalised."""
    norm = normalize(slashes(path))
    return F.startswith(slashes(path), F.lit("/")) | (norm == "..") | F.startswith(norm, F.lit("../"))


def strip_module_extension(path: Column) -> Column:
    """C11."""
    return F.regexp_replace(path, MODULE_EXTENSION, "")


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether a text holds one of the parts; parts that hold another are not looked for."""
    wanted = set(parts)
    least = sorted(p for p in wanted if not any(q != p and q in p for q in wanted))
    return reduce(or_, [F.contains(text, F.lit(p)) for p in least])


def rlike_with(path: Column, pattern: str, needed: Iterable[str]) -> Column:
    """A regex asked only of paths that hold, in lower case, one of the parts ``needed`` that it cannot do without."""
    return bind(path, lambda p: bind(F.lower(p), lambda low: contains_any(low, needed)) & F.rlike(p, F.lit(pattern)))


def is_sensitive(path: Column) -> Column:
    """Credential files, by name, ending or location, of a path with slashes.

    The path expression is evaluated once; locations are the only part that
    depends on case.
    """
    def either(values: list[str]) -> str:
        return "|".join(v.replace(".", r"\.") for v in values)

    name = rf"\.env(?:\.[^/]*)?|{either(SENSITIVE_NAMES)}|[^/]*(?:{either(SENSITIVE_SUFFIXES)})"
    needed = [".env", *SENSITIVE_NAMES, *SENSITIVE_SUFFIXES, *SENSITIVE_PATHS]
    return rlike_with(path, rf"(?:{either(SENSITIVE_PATHS)})|(?:^|/)(?i:{name})$", needed)


def clean_extensions(exts: str | Iterable[str] | None) -> list[str] | None:
    """P5: a list or comma list to lower-case dotted extensions; empty means no filter."""
    if not exts:
        return None
    given = exts.split(",") if isinstance(exts, str) else list(exts)
    names = [e.strip().lower() for e in given]
    dotted = [e if e.startswith(".") else f".{e}" for e in names if e]
    return sorted(set(dotted)) or None


def extension_in(path: Column, exts: str | Iterable[str] | None) -> Column | None:
    """P5 as a predicate, or None when there is nothing to filter on."""
    wanted = clean_extensions(exts)
    return None if wanted is None else F.lower(extension(path)).isin(wanted)


def path_contains(path: Column, pattern: str | None) -> Column | None:
    """P6 as a predicate, or None when there is nothing to filter on."""
    wanted = (pattern or "").strip().lower().replace("\\", "/")
    return F.contains(F.lower(slashes(path)), F.lit(wanted)) if wanted else None


def within_depth(path: Column, max_depth: int | None) -> Column | None:
    """A path may have at most ``max_depth + 1`` components."""
    return None if max_depth is None else depth(path) <= max_depth


def size_kb(size: Column) -> Column:
    """Kilobytes with one decimal."""
    return F.floor(size / 1024 * 10 + 0.5) / 10
