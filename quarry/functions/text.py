"""Text functions: keys, slugs, numbers, addresses, tags, formatting."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry import tables
from quarry.functions.numeric import any_substring, lookup


def squeeze(x: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def slugify(x: Column, width: int | None = None) -> Column:
    """Lower case, other runs as one hyphen, none at the ends; cut to width."""
    out = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.substring(out, 1, width) if width else out


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def strip_suffix_key(family: Column, tag: Column, pattern: str = tables.QUANT_SUFFIX, default: str = "default") -> Column:
    """family:tag without the trailing format token; default where nothing is left."""
    return F.concat(family, F.lit(":"), F.coalesce(F.nullif(F.regexp_replace(tag, pattern, ""), F.lit("")), F.lit(default)))


def split_ref(ref: Column) -> tuple[Column, Column]:
    """What stands before and after the first colon; null where there is none."""
    has = F.contains(ref, F.lit(":"))
    return F.when(has, F.substring_index(ref, ":", 1)), F.when(has, F.regexp_extract(ref, "^[^:]*:(.*)$", 1))


def parse_number(x: Column) -> Column:
    """First number of a table cell: links and bold marks are taken off, commas dropped; N/A words give null."""
    plain = F.regexp_replace(F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*,]", "")
    none = F.lower(F.trim(plain)).isin("", "-", "–", "—", "n/a", "na", "none")
    return F.when(~none, F.nullif(F.regexp_extract(plain, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double"))


def epoch_to_iso(seconds: Column) -> Column:
    """ISO 8601 in UTC; null for what isn't a positive number."""
    n = seconds.try_cast("long")
    return F.when(n > 0, F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def signal_tags(text: Column) -> Column:
    """Capability tags by hint, in a fixed order."""
    hints = [("code", tables.CODE_HINTS), ("embedding", tables.EMBED_HINTS), ("reasoning", tables.REASON_HINTS)]
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(any_substring(low, parts), F.lit(name)) for name, parts in hints]))


def normalize_code(code: Column, aliases: dict[str, str], placeholders: tuple[str, ...]) -> Column:
    """Upper case with underscores; placeholders are null; aliases are named alike."""
    plain = F.upper(F.replace(F.trim(code), F.lit("-"), F.lit("_")))
    out = plain
    for old, new in aliases.items():
        out = F.when(plain == old, F.lit(new)).otherwise(out)
    return F.when(~plain.isin(*placeholders), out)


def normalize_quant(value: Column, tag: Column) -> Column:
    """Name of a stored format: a type number's, else the value's, else that of the format token within the tag, else null."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    numbered = lookup(text, {str(k): v for k, v in tables.FILE_TYPES.items()})
    named = normalize_code(text, {"FP16": "F16", "FLOAT16": "F16", "FP32": "F32", "FLOAT32": "F32"}, tuple(w.upper() for w in tables.NO_FORMAT))
    token = F.nullif(F.regexp_extract(F.coalesce(tag, F.lit("")), tables.TAG_FORMAT, 1), F.lit(""))
    return F.coalesce(numbered, named, F.when(F.lower(token) == "fp16", "F16").otherwise(F.upper(token)))


def plain_number(x: Column) -> Column:
    """Six significant digits without trailing zeros: 7, 0.5, 1.55."""
    digits = F.when(x == 0, F.lit(0)).otherwise(F.least(F.lit(12), F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(x)))))).cast("int")
    text = F.format_string("%.12f", F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))
    return F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ""))


def clean_repo(url: Column, host: str = "huggingface.co") -> Column:
    """owner/name of an http(s) address on exactly this host; null otherwise."""
    path = F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    owner, name = F.get(F.split(path, "/"), F.lit(0)), F.get(F.split(path, "/"), F.lit(1))
    segment = "^[A-Za-z0-9][A-Za-z0-9_.-]*$"
    ok = (
        F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
        & (F.lower(F.try_parse_url(url, F.lit("HOST"))) == host)
        & owner.rlike(segment)
        & name.rlike(segment)
        & ~F.lower(owner).isin(*tables.RESERVED_PATHS)
    )
    return F.when(ok, F.concat(owner, F.lit("/"), name))


def features(text: Column) -> dict[str, Column]:
    """Sorted distinct size tokens, modes and other qualifiers of a tag."""
    low = F.lower(text)
    sizes = F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({tables.SIZE_TOKEN[4:]})"), F.lit(1))))
    rest = F.regexp_replace(low, tables.SIZE_TOKEN, " ")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(rest, F.lit(r"([a-z0-9]+(?:\.[a-z0-9]+)*)"), F.lit(1))))
    modes = F.array(*map(F.lit, sorted(tables.MODES)))
    skip = F.array(*map(F.lit, (*tables.MODES, *tables.GENERIC)))
    return {"sizes": sizes, "modes": F.array_intersect(modes, words), "qualifiers": F.array_except(words, skip)}


def format_params(n: Column) -> Column:
    """8B, 1.5B, 70B, 270M, 1.2T: tenths below ten units, whole units above; a dash for none."""
    def tenths(unit: int) -> Column:
        k = F.floor((n + unit // 20) / (unit // 10))
        return F.concat(F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"))

    def whole(unit: int) -> Column:
        return F.floor((n + unit // 2) / unit).cast("string")

    tera, giga, mega = 10**12, 10**9, 10**6
    return (
        F.when(n.isNull() | (n == 0), F.lit("—"))
        .when(n >= 10 * tera, F.concat(whole(tera), F.lit("T")))
        .when(n >= tera, F.concat(tenths(tera), F.lit("T")))
        .when(n >= 10 * giga, F.concat(whole(giga), F.lit("B")))
        .when(n >= giga, F.concat(F.replace(tenths(giga), F.lit(".0"), F.lit("")), F.lit("B")))
        .otherwise(F.concat(whole(mega), F.lit("M")))
    )


def format_bytes(n: Column) -> Column:
    """950 MB, 4.37 GB, 39.6 GB; a dash for none."""
    gb = n / 1e9
    return (
        F.when(n.isNull(), F.lit("—"))
        .when(gb < 1, F.concat(F.floor(gb * 1000 + 0.5).cast("string"), F.lit(" MB")))
        .when(gb >= 10, F.format_string("%.1f GB", gb))
        .otherwise(F.format_string("%.2f GB", gb))
    )


def format_ctx(n: Column) -> Column:
    """512, 8k, 1.5k; a dash for none."""
    return (
        F.when(n.isNull() | (n == 0), F.lit("—"))
        .when(n < 1024, n.cast("string"))
        .when(n % 1024 == 0, F.concat(F.floor(n / 1024).cast("string"), F.lit("k")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1024), F.lit("k")))
    )


def format_speed(tps: Column) -> Column:
    return F.when(tps.isNull(), "Not modeled").when(tps >= 100, F.format_string("%.0f tok/s", tps)).otherwise(F.format_string("%.1f tok/s", tps))


def attention_label(window: Column, full_layers: Column) -> Column:
    has = F.coalesce(window, F.lit(0)) > 0
    return (
        F.when(has & (F.coalesce(full_layers, F.lit(0)) > 0), F.concat(F.lit("hybrid "), format_ctx(window), F.lit(" SWA + global")))
        .when(has, F.concat(format_ctx(window), F.lit(" sliding window")))
        .otherwise("dense attention")
    )


def device_group(vendor: Column, ident: Column) -> Column:
    consumer = F.startswith(ident, F.lit("rtx")) & ~F.startswith(ident, F.lit("rtxa")) & (ident != "rtx6000ada")
    return F.when(vendor == "apple", "Apple silicon").when(vendor == "amd", "AMD").when(vendor == "cpu", "CPU only").when(consumer, "GeForce / RTX").otherwise("Datacenter / workstation")


def has_token(name: Column, token: str) -> Column:
    """Whether a device name has this token, not as part of a longer one."""
    return F.replace(F.upper(name), F.lit("_"), F.lit(" ")).rlike(rf"(^|[^A-Z0-9]){token}([^A-Z0-9]|$)")


@F.pandas_udf(StringType())
def unescape_html(x: pd.Series) -> pd.Series:
    """All named and numbered entities, once each; the table is the standard library's."""
    return x.map(html.unescape, na_action="ignore")


def format_duration(seconds: Column) -> Column:
    """2h05m09s, 5m09s or 9s; a question mark for less than nothing or no number."""
    s = F.bround(seconds, 0).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "?").when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))
    )


def format_date(at: Column) -> Column:
    """Mar 4, 2025; a dash for none."""
    return F.coalesce(F.date_format(at, "MMM d, yyyy"), F.lit("—"))


def params_headline(params: Column, active: Column, outside: Column) -> Column:
    """Active and all parameters where embeddings outside the device make a difference of a tenth, else all."""
    split = (F.coalesce(outside, F.lit(0)) != 0) & (params > F.coalesce(active, F.lit(0)) * 1.1)
    return F.when(split, F.concat(format_params(active), F.lit(" effective · "), format_params(params), F.lit(" with embeddings"))).otherwise(F.concat(format_params(params), F.lit(" parameters")))


def signal_label(signal: Column) -> Column:
    return F.coalesce(lookup(signal, tables.SIGNAL_LABELS), signal)


def fit_label(fit: Column) -> Column:
    return lookup(fit, tables.FIT_LABELS)


def short_device(name: Column) -> Column:
    """A device's name without its maker's."""
    return F.regexp_replace(name, "NVIDIA GeForce |NVIDIA |Apple ", "")


def safe_url(url: Column, site: str) -> Column:
    """The address if it is http(s), whole if it is one of the site's own pages or files; else null."""
    plain = F.replace(F.trim(F.coalesce(url, F.lit(""))), F.lit("&amp;"), F.lit("&"))
    own = F.startswith(plain, F.lit("/assets/")) | F.startswith(plain, F.lit("/library/"))
    return F.when(plain.rlike("(?i)^https?://"), plain).when(own, F.concat(F.lit(site), plain))


def parse_timestamp(x: Column) -> Column:
    """2025-01-31T09:05:00Z or with +00:00 at its end; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(x, r"(Z|\+00:00)$", ""), F.when(x.rlike(r"(Z|\+00:00)$"), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def textarea(page: Column, ident: str) -> Column:
    return F.trim(unescape_html(F.regexp_extract(page, rf"(?is)<textarea\b[^>]*\bid=[\"']{ident}[\"'][^>]*>(.*?)</textarea\s*>", 1)))


def page_copy(page: Column, site: str, description_chars: int = 255, readme_chars: int = 100_000) -> tuple[Column, Column]:
    """Description (meta tag, else summary field) and readme of a page; addresses within the site become whole."""
    meta = F.trim(unescape_html(F.regexp_extract(page, r"(?is)<meta\s[^>]*name=[\"']description[\"'][^>]*content=\"([^\"]*)\"", 1)))
    description = F.when(meta != "", meta).otherwise(textarea(page, "summary-textarea"))
    readme = F.regexp_replace(F.regexp_replace(textarea(page, "editor"), r"(\]\()(/assets/)", rf"$1{site}/assets/"), r"(src=[\"'])(/assets/)", rf"$1{site}/assets/")
    return F.rtrim(F.substring(description, 1, description_chars)), F.rtrim(F.substring(readme, 1, readme_chars))


def size_class(params: Column) -> Column:
    """Class of a parameter count; 0 and null are unknown."""
    out = F.when(params.isNull() | (params == 0), F.lit("unknown"))
    for name, below in tables.SIZE_CLASSES:
        out = out.when(params < below, F.lit(name))
    return out.otherwise(F.lit("frontier"))


def page_links(pages, key: str, html_column: str, prefix: str):
    """Distinct last parts of links on a page to prefix/name: names of a library, or tags of a model with its name and a colon as prefix."""
    literal = "".join(c if c.isalnum() or c in "/_-:" else "\\" + c for c in prefix)
    found = F.regexp_extract_all(html_column, F.lit(f'href="{literal}([^"/]+)"'), F.lit(1))
    return pages.select(key, F.explode(found).alias("link")).distinct()
