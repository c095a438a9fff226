"""Addresses: canonical form, resolution against a base, and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsight.functions.text import col, contains_any, let, none_if_blank, strip
from fleetsight.functions.redact import is_sensitive_name, looks_sensitive

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


# A lower-case host, a path and a query of unreserved characters only: nothing but a sensitive name can need cleaning.
_PLAIN = r"^https?://[a-z0-9.\-]+(?:/[^?#\s]*)?(?:\?[\w.~\-]+=[\w.~\-]*(?:&[\w.~\-]+=[\w.~\-]*)*\z)?$"
# In canonical form already.
_CANONICAL = r"^https?://[a-z0-9.:\-]+/[^?#]*(?:\?[^#]+)?\z"


def split_url(url: Column) -> Column:
    """Struct of the five parts of an address; a missing part is the empty string."""
    names = ("scheme", "authority", "path", "query", "fragment")
    parts = {name: F.regexp_extract(url, _SPLIT, group) for group, name in enumerate(names, start=1)}
    parts["scheme"] = F.lower(parts["scheme"])
    return F.struct(*[part.alias(name) for name, part in parts.items()])


def _after(mark: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(mark), value)).otherwise(F.lit(""))


def _rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def canonical_url(value: Column | str) -> Column:
    """Fragment dropped, host lowered, empty path as ``/`` for http(s); other text only trimmed."""

    def web(parts: Column) -> Column:
        return F.concat(
            parts["scheme"],
            F.lit("://"),
            F.lower(parts["authority"]),
            _rooted(parts["path"]),
            _after("?", parts["query"]),
        )

    trimmed = none_if_blank(strip(col(value).cast("string")))
    # The five parts, the test and the other branch read the text; written out they would each trim it again.
    return let(
        trimmed, lambda text: F.when(text.rlike("(?i)^https?:") & ~text.rlike(_CANONICAL), let(split_url(text), web)).otherwise(text)
    )


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, segment: F.when(segment == ".", done)
        .when(segment == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(segment))),
    )
    joined = F.array_join(kept, "/")
    return F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(F.regexp_replace(joined, "/$", ""), F.lit("/"))).otherwise(joined)


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """Resolve a link against the address of the page it was found on."""

    def resolve(both: Column) -> Column:
        root, link = both["root"], both["link"]
        own_authority = link["authority"] != ""
        same_scheme = (link["scheme"] == "") | (link["scheme"] == root["scheme"])
        folder = F.regexp_replace(root["path"], "[^/]*$", "")
        path = (
            F.when(own_authority, link["path"])
            .when(link["path"] == "", root["path"])
            .when(link["path"].startswith("/"), _without_dots(link["path"]))
            .otherwise(_without_dots(_rooted(F.concat(folder, link["path"]))))
        )
        inherits_query = (link["path"] == "") & (link["query"] == "") & ~own_authority
        resolved = F.concat(
            F.when(link["scheme"] != "", link["scheme"]).otherwise(root["scheme"]),
            F.lit("://"),
            F.when(own_authority, link["authority"]).otherwise(root["authority"]),
            let(path, lambda found: F.when((found != "") & ~found.startswith("/"), F.concat(F.lit("/"), found)).otherwise(found)),
            _after("?", F.when(inherits_query, root["query"]).otherwise(link["query"])),
            _after("#", link["fragment"]),
        )
        hierarchical = root["scheme"].isin("http", "https", "ftp", "file")
        return (
            F.when(both["href"] == "", both["base"])
            .when(~same_scheme | ~hierarchical, both["href"])
            .otherwise(resolved)
        )

    trimmed = F.trim(col(href))
    both = F.struct(
        col(base).alias("base"),
        trimmed.alias("href"),
        split_url(col(base)).alias("root"),
        split_url(trimmed).alias("link"),
    )
    return let(both, resolve)


def _decode(text: Column) -> Column:
    """Form decoding that leaves a stray percent sign alone."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    """Form encoding with ``~`` kept and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query_pairs(query: Column) -> Column:
    pieces = F.filter(F.split(query, "&"), lambda piece: piece != "")
    return F.transform(
        pieces,
        lambda piece: F.struct(
            _decode(F.substring_index(piece, "=", 1)).alias("name"),
            _decode(
                F.when(piece.contains("="), F.substring(piece, F.instr(piece, "=") + 1, F.length(piece))).otherwise(
                    F.lit("")
                )
            ).alias("value"),
        ),
    )


def _sensitive_pair(pair: Column) -> Column:
    return is_sensitive_name(pair["name"]) | looks_sensitive(pair["value"])


def _safe_authority(authority: Column) -> Column:
    """User info dropped, host lowered, port kept when it is a number."""
    host_port = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.regexp_extract(host_port, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:]*):([0-9]+)$", 1)
    plain_port = F.when(port != "", F.concat(F.lit(":"), port.cast("int").cast("string"))).otherwise(F.lit(""))
    hidden = authority.contains("@") | looks_sensitive(authority)
    return F.when(host != "", F.concat(host, plain_port)).when(hidden, F.lit("")).otherwise(authority)


def _safe_query(query: Column) -> Column:
    kept = F.filter(_query_pairs(query), lambda pair: ~_sensitive_pair(pair))
    return F.array_join(
        F.transform(kept, lambda pair: F.concat(_encode(pair["name"]), F.lit("="), _encode(pair["value"]))), "&"
    )


def _safe_fragment(fragment: Column) -> Column:
    hidden = looks_sensitive(fragment) | F.exists(_query_pairs(fragment), _sensitive_pair)
    return F.when(hidden, F.lit("")).otherwise(fragment)


def safe_url(value: Column | str) -> Column:
    """Drop credentials, sensitive query items and sensitive fragments; re-encode the query."""

    def clean(parts: Column) -> Column:
        located = let(
            _safe_authority(parts["authority"]),
            lambda authority: F.when(
                authority != "",
                F.concat(
                    F.lit("//"), authority, F.when(parts["path"] != "", _rooted(parts["path"])).otherwise(F.lit(""))
                ),
            ).otherwise(parts["path"]),
        )
        scheme = F.when(parts["scheme"] != "", F.concat(parts["scheme"], F.lit(":"))).otherwise(F.lit(""))
        query = F.when(parts["query"] != "", let(_safe_query(parts["query"]), lambda text: _after("?", text)))
        fragment = F.when(parts["fragment"] != "", _after("#", _safe_fragment(parts["fragment"])))
        return F.concat(scheme, located, F.coalesce(query, F.lit("")), F.coalesce(fragment, F.lit("")))

    def cleaned(url: Column) -> Column:
        plain = url.rlike(_PLAIN) & (~F.contains(url, F.lit("?")) | ~is_sensitive_name(url))
        return F.when(url.isNull() | (url == "") | plain, url).otherwise(let(split_url(url), clean))

    return let(col(value), cleaned)


def looks_like_advisory(url: Column, label: Column, pdf_terms: tuple[str, ...], terms: tuple[str, ...]) -> Column:
    def judge(seen: Column) -> Column:
        haystack = F.concat_ws(" ", seen["path"], seen["query"], seen["label"])
        is_named_pdf = seen["path"].endswith(".pdf") & contains_any(seen["label"], pdf_terms)
        return is_named_pdf | let(haystack, lambda text: contains_any(text, terms))

    parts = split_url(url)
    return let(
        F.struct(
            F.lower(parts["path"]).alias("path"), F.lower(parts["query"]).alias("query"), F.lower(label).alias("label")
        ),
        judge,
    )
