"""URL normal form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import strip

# Fixed values
ALLOWED_PORTS = (80, 443)
URL_PARTS = r"(?i)^(https?)://(?:([^/?#@]*)@)?(\[[0-9a-f:.]+\]|[^/?#:@]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"


@F.pandas_udf(T.StringType())
def idna_host(hosts: pd.Series) -> pd.Series:
    """ASCII form of a non-ASCII host; null when it has none."""
    def encode(host):
        try:
            return None if host is None else host.encode("idna").decode("ascii")
        except UnicodeError:
            return None
    return hosts.map(encode)


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(strip(url), URL_PARTS, group)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(url_part(url, 3)), r"\.+$", "")


def canonical_url(url: Column, idna: bool = False) -> Column:
    """Normal form, or null for a URL that is not accepted.

    ``idna`` adds the Python step for non-ASCII hosts; without it they are null.
    """
    scheme, name, port, path = F.lower(url_part(url, 1)), host(url), url_part(url, 4), url_part(url, 5)
    ascii_host = F.when(~name.rlike(r"[^\x00-\x7f]"), name)
    if idna:
        ascii_host = F.coalesce(ascii_host, idna_host(name))
    default = F.when(scheme == "https", "443").otherwise("80")
    allowed = (port == "") | port.try_cast("int").isin(*ALLOWED_PORTS)
    netloc = F.concat(ascii_host, F.when((port != "") & (port != default), F.concat(F.lit(":"), port))
                      .otherwise(F.lit("")))
    user = F.regexp_extract(strip(url), r"^[^/]*//[^/?#]*@", 0)
    ok = (scheme != "") & (name != "") & (user == "") & allowed & ~name.rlike(r"[\r\n\t%]")
    return F.when(ok, F.concat(scheme, F.lit("://"), netloc,
                               F.when(path == "", F.lit("/")).otherwise(path), url_part(url, 6)))
