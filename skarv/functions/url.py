"""Addresses of pages, as Column expressions; an address that can't be read gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings under which names are registered that have two labels.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.nz", "co.jp", "com.br", "priv.no", "kommune.no", "oslo.no")
#: Hosts of profiles and the platform each belongs to.
PLATFORMS = {"facebook.com": "facebook", "fb.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "x.com": "x", "twitter.com": "x", "youtube.com": "youtube", "tiktok.com": "tiktok"}
#: First parts of a path that are no profile.
NO_PROFILE = {
    "facebook": ("sharer", "sharer.php", "share.php", "dialog", "policy.php", "privacy", "events", "groups", "plugins", "profile.php"),
    "instagram": ("p", "reel", "reels", "stories", "explore"),
    "x": ("intent", "share", "home", "search", "i"),
}
#: First parts of a path before the name of a channel.
CHANNELS = ("channel", "user", "c")


def absolute(url: Column) -> Column:
    """With a scheme: ``https`` where none is given; null where it isn't ``http(s)``."""
    text = F.trim(url)
    given = F.regexp_extract(F.lower(text), r"^([a-z][a-z0-9+.-]*)://", 1)
    return F.when(given.isin("http", "https"), text).when((given == "") & text.rlike(r"^[^\s/:]+\.[^\s/:]+"), F.concat(F.lit("https://"), text))


def host(url: Column) -> Column:
    """The host in lower case, without ``www.``, user and port."""
    found = F.regexp_extract(F.lower(absolute(url)), r"^https?://(?:[^/?#@\s]*@)?(?:www\.)?([^/?#:\s]+)", 1)
    return F.nullif(found, F.lit(""))


def path(url: Column) -> Column:
    found = F.regexp_extract(absolute(url), r"^[a-zA-Z]+://[^/?#\s]+(/[^?#\s]*)?", 1)
    return F.when(absolute(url).isNotNull(), F.when(found == "", "/").otherwise(found))


def homepage(url: Column) -> Column:
    """Scheme, host and path; parameters, query and fragment dropped, the path at least ``/``."""
    scheme = F.regexp_extract(F.lower(absolute(url)), r"^(https?)://", 1)
    where = F.regexp_extract(F.lower(absolute(url)), r"^https?://(?:[^/?#@\s]*@)?([^/?#\s]+)", 1)
    return F.when(where != "", F.concat(scheme, F.lit("://"), where, F.regexp_replace(path(url), ";.*$", "")))


def registered_domain(name: Column) -> Column:
    """The last two labels of a host, three under ``TWO_LABEL_SUFFIXES``; the host itself if it has fewer."""
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(name.isNotNull(), F.when(last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2)))


def registered_domains(rows: DataFrame, name: str, suffixes: DataFrame) -> DataFrame:
    """``rows`` with ``domain``: one label more than the longest of ``suffixes`` (``suffix``) that the host ends in; null for a suffix itself.

    An equality join on the host's endings. Hosts under no listed suffix have
    their last two labels, as under any single one.
    """
    hosts = rows.select(F.col(name).alias("_host")).where("_host is not null").distinct()
    ends = hosts.select("_host", F.posexplode(host_suffixes(F.col("_host"))).alias("_at", "suffix"))
    listed = suffixes.select("suffix").distinct()
    longest = ends.join(listed, "suffix").groupBy("_host").agg(F.min("_at").alias("_at"))
    labels = F.split("_host", r"\.")
    begin = F.coalesce(F.col("_at"), F.greatest(F.size(labels) - 1, F.lit(1)))
    told = hosts.join(longest, "_host", "left").select("_host", F.when(begin > 0, F.array_join(F.slice(labels, begin, F.size(labels)), ".")).alias("domain"))
    return rows.join(told, F.col(name) == F.col("_host"), "left").drop("_host")


def host_suffixes(name: Column) -> Column:
    """A host and all it ends in: ``a.b.c``, ``b.c``, ``c``; a join on these is a join on endings."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def profile(url: Column) -> Column:
    """``struct(platform, url)`` of a company's profile on a platform; null for other pages of it.

    A profile is a company page with its name, a channel by its name or a
    handle, an account alone; a platform's other hosts give its own.
    """
    domain = registered_domain(host(url))
    platform = F.try_element_at(F.create_map(*(F.lit(x) for pair in PLATFORMS.items() for x in pair)), domain)
    parts = F.filter(F.transform(F.split(path(url), "/"), F.trim), lambda p: p != "")
    first, many = F.lower(F.get(parts, F.lit(0))), F.size(parts)
    handle = F.startswith(first, F.lit("@"))
    fits = {
        "facebook": ~first.isin(*NO_PROFILE["facebook"]),
        "instagram": ~first.isin(*NO_PROFILE["instagram"]),
        "linkedin": (first == "company") & (many >= 2),
        "x": ~first.isin(*NO_PROFILE["x"]) & (many == 1),
        "youtube": handle | first.isin(*CHANNELS),
        "tiktok": handle,
    }
    kept = F.when(platform == "linkedin", F.slice(parts, 1, 2)).when(platform == "youtube", F.when(handle, F.slice(parts, 1, 1)).otherwise(F.slice(parts, 1, 2))).otherwise(parts)
    good = F.lit(False)
    for name, condition in fits.items():
        good = good | ((platform == name) & condition)
    return F.when(good & (many > 0), F.struct(platform.alias("platform"), F.concat(F.lit("https://"), platform, F.lit(".com/"), F.array_join(kept, "/")).alias("url")))


def web_address(url: Column) -> Column:
    """Whether it is ``http(s)`` with a host and without a user or password."""
    return F.coalesce(url.rlike(r"^https?://[^\s/?#@]+(?:[/?#][^\s]*)?$"), F.lit(False))


def domain_guesses(words: Column, ending: str = "no", least: int = 5) -> Column:
    """Hosts a name may have: its words run together, and with hyphens if there are several; short ones aren't guessed."""
    joined, hyphened = F.array_join(words, ""), F.array_join(words, "-")
    both = F.array(F.when(F.length(joined) >= least, joined), F.when((F.size(words) > 1) & (F.length(joined) >= least), hyphened))
    return F.transform(F.array_compact(both), lambda g: F.concat(g, F.lit(f".{ending}")))


def company_page(url: Column) -> Column:
    """The one address of a company's page on the network of professions; null for other pages."""
    parts = F.filter(F.transform(F.split(path(url), "/"), lambda p: F.trim(F.try_url_decode(p))), lambda p: p != "")
    fits = registered_domain(host(url)).eqNullSafe(F.lit("linkedin.com")) & (F.lower(F.get(parts, F.lit(0))) == "company") & (F.size(parts) >= 2)
    slug = F.replace(F.url_encode(F.lower(F.get(parts, F.lit(1)))), F.lit("+"), F.lit("%20"))
    return F.when(fits, F.concat(F.lit("https://linkedin.com/company/"), F.replace(slug, F.lit("%7E"), F.lit("~"))))


def page_of_name(name: Column) -> Column:
    """Where a company's page would be by its legal name; null without a word."""
    words = F.regexp_extract_all(F.replace(F.replace(F.replace(F.lower(name), F.lit("æ"), F.lit("ae")), F.lit("ø"), F.lit("o")), F.lit("å"), F.lit("a")), F.lit("[a-z0-9]+"), 0)
    return F.when(F.size(words) > 0, F.concat(F.lit("https://www.linkedin.com/company/"), F.array_join(words, "-")))


def updates_query(base: str, kind: str, numbers: Column, since: str, page: int = 0, size: int = 100) -> Column:
    """The address that asks for the updates of several entities."""
    return F.concat(F.lit(f"{base}/{kind}?organisasjonsnummer="), F.array_join(numbers, "%2C"), F.lit(f"&dato={since}&size={size}&page={page}&includeChanges=true"))


def public_address(name: Column) -> Column:
    """Whether a host is no address of a private, local or reserved network, as far as its writing tells."""
    octets = F.transform(F.split(name, r"\."), lambda o: o.try_cast("int"))
    four = name.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    private = (a.isin(0, 10, 127)) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    named = ~F.lower(name).rlike(r"^(?:localhost|.*\.(?:local|localhost|internal))$") & F.contains(name, F.lit("."))
    return F.coalesce(F.when(name.contains(":"), F.lit(False)).when(four, ~private & ~F.exists(octets, lambda o: o > 255)).otherwise(named & ~name.rlike(r"^[0-9.]+$")), F.lit(False))
