"""Queries on readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.plans.registry import query
from foliant.session import table
from foliant.sources import readers

_STEPS = (
    (r"(?is)<script\b[^>]*>.*?</script>", ""), (r"(?is)<style\b[^>]*>.*?</style>", ""), (r"(?is)<head\b[^>]*>.*?</head>", ""), (r"(?is)<!--.*?-->", ""),
    (r"(?i)</?(?:p|div|br|li|h1|h2|h3|tr|section)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
    (r"[ \t]+", " "), (r" ?\n[ \n]*", "\n"),
)
_HTML_SQL = "html"
for _a, _b in _STEPS:
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '{_a}', " + ("chr(10)" if _b == "\n" else f"'{_b}'") + ", 'g')"


@query("html_to_text", f"SELECT page_id, md5(trim({_HTML_SQL}, ' ' || chr(10))) AS digest FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(readers.html_text(F.col("html"))).alias("digest"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
