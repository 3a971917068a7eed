"""Expressions over host names and queries."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space around a name.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"


def plain_form(name: Column) -> Column:
    """Lower case, no white space around, no trailing dots; NULL for NULL, ``-`` and empty.

    Trailing dots and white space go together, so ``"A.b . "`` is ``a.b``.
    """
    bare = F.ltrim(F.rtrim(F.lower(name), F.lit(WHITE + ".")), F.lit(WHITE))
    return F.when((bare != "") & (bare != "-"), bare)


def plain_form_sql(name: str) -> str:
    """``plain_form`` in the SQL that DuckDB runs."""
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    bare = f"ltrim(rtrim(lower({name}), {white} || '.'), {white})"
    return f"nullif(nullif({bare}, ''), '-')"


#: Rewrites of host names into their service's common form, in order.
_REWRITES = (
    (r"[a-z0-9]+\.cloudfront.net", "X.cloudfront.net"),
    (r"[a-z0-9]+\.profile\..*\.cloudfront.net", "X.cloudfront.net"),
    (r"---sn-.*\.googlevideo\.com", "---sn-X.googlevideo.com"),
    (r"---sn-.*\.c\.pack\.google\.com", "---sn-X.c.pack.google.com"),
    (r"[0-9]+", "D"),
)
#: A single letter between delimiters; neighbours share a delimiter, so it is applied twice.
_LETTER = r"(^|[-._D])[a-z]([-._D])"

#: Suffixes under which a site's name has three labels.
SUFFIXES = (
    "co.uk co.jp co.hu co.il com.au co.ve .co.in com.ec com.pk co.th co.nz com.br com.sg com.sa com.do co.za com.hk com.mx com.ly com.ua com.eg "
    "com.pe com.tr co.kr com.ng com.ph com.my com.tw com.kw co.in co.id com.com com.vn com.bd com.ar com.co org.uk net.gr"
).split()


def service_form(name: Column) -> Column:
    """A host name with hashes, numbers and single letters replaced, so that a service's many hosts share one name. NULL stays NULL."""
    for pattern, into in _REWRITES:
        name = F.regexp_replace(name, pattern, into)
    for _ in range(2):
        name = F.regexp_replace(name, _LETTER, "$1C$2")
    return name


def service_form_sql(name: str) -> str:
    """``service_form`` in the SQL that DuckDB runs."""
    for pattern, into in _REWRITES:
        name = f"regexp_replace({name}, '{pattern}', '{into}', 'g')"
    for _ in range(2):
        name = rf"regexp_replace({name}, '{_LETTER}', '\1C\2', 'g')"
    return name


def _undotted(fqdn: Column) -> Column:
    return F.when(fqdn.endswith("."), fqdn.substr(F.lit(1), F.length(fqdn) - 1)).otherwise(fqdn)


def second_level(fqdn: Column) -> Column:
    """The last two labels, without one trailing dot."""
    return F.substring_index(_undotted(fqdn), ".", -2)


def third_level(fqdn: Column) -> Column:
    """The last three labels."""
    return F.substring_index(_undotted(fqdn), ".", -3)


def site(fqdn: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The registered name: three labels under one of ``suffixes``, else two."""
    return F.when(second_level(fqdn).isin(suffixes), third_level(fqdn)).otherwise(second_level(fqdn))


def site_sql(fqdn: str) -> str:
    """``site`` in the SQL that DuckDB runs."""
    bare = f"regexp_replace({fqdn}, '[.]$', '')"
    labels = lambda n: f"array_to_string(list_slice(string_split({bare}, '.'), -{n}, -1), '.')"
    known = ", ".join(f"'{s}'" for s in SUFFIXES)
    return f"CASE WHEN {labels(2)} IN ({known}) THEN {labels(3)} ELSE {labels(2)} END"
