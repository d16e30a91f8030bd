"""Documentation pages rendered from the rows of the given tables.

One page per row, so rendering needs no grouping. Rows are dealt out before they are rendered, so that only narrow
ones move. Nothing here uses the extraction code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.session import spread_small
from workload.base import table

# One API page per part: endpoint table, error table, schema, code and prose around them.
API_PAGE = r"""
concat(
  '<!DOCTYPE html><html><head><title>', p_name, ' | Vendor Docs</title><script>var x = "<p>";</script></head><body>',
  '<nav><ul><li>', p_brand, '</li></ul></nav><header><h2>Site</h2></header><main>',
  '<h1> ', p_name, ' </h1>',
  if(p_size > 40, concat('<p>Intro. The ', p_type, ' call is deprecated since v2. Use another.</p>'), '<p>Intro only.</p>'),
  '<div class="table wide"><div><div>Endpoint</div><div> METHOD </div></div><div><div>/v3/', lower(p_type), '/', p_partkey,
  '</div><div>', if(p_size > 25, 'post', 'Get'), '</div></div><div><div>/v3/none</div><div>LINK</div></div></div>',
  '<h2>Request</h2><pre><code class="hl language-JSON">{"id": ', p_partkey, '}', '</code></pre>',
  '<h2>', p_brand, ' <b>item</b></h2>',
  '<div class="table"><div><div>Property</div><div>Type</div><div>Description</div><div>Range/Limits</div></div>',
  '<div><div>id', p_size, '</div><div>String&lt;br /&gt;Required</div><div>Key of ', p_name, '</div><div>Max: ', p_size, ' characters</div></div>',
  '<div><div>price</div><div>Number<br/>Optional</div><div>', if(p_size > 30, 'No longer supported.', 'Plain &amp; simple'), '</div></div>',
  '<div><div>tag</div><div>Array of tags<br>(read only)</div><div>first<br>second</div><div></div></div>',
  '<div><div> </div><div>String</div><div>nameless</div><div></div></div></div>',
  '<h3>Errors</h3><div class="table"><div><div>Endpoint</div><div>Error Code</div><div>Error Response</div><div>Reason</div></div>',
  '<div><div>POST /v3/', lower(p_type), '/', p_partkey, '</div><div>', 1000 + p_partkey, '</div><div>bad&lt;br /&gt;', p_brand, '</div><div> ', p_name, '  failed </div></div>',
  '<div><div>too</div><div>short</div></div></div>',
  '<div class="table"><div><div>REASON_CODE</div><div>Description</div></div><div><div>BAD_', upper(p_type), '</div><div>', p_brand, '</div></div></div>',
  '<h3>Status</h3><div class="table"><div><div>Status Code</div><div>Description</div><div>Applicable Resources</div></div>',
  '<div><div>', 2000 + p_size, '</div><div>', p_type, '</div><div>Order, Subscription Transfer</div></div></div>',
  '<div class="table"><div><div>Status Code</div><div>Description</div></div><div><div>404</div><div>Not found</div></div></div>',
  '<div class="table"><div><div>Field Name</div><div>Resource/Object</div><div>Regular Expression (String)</div><div>Notes</div></div>',
  '<div><div>f', p_size, '</div><div>', p_brand, '</div><div>^[a-z]{1,', p_size, '}$</div><div>', if(p_size > 20, '', 'short'), '</div></div></div>',
  '<pre><code>plain ', p_partkey, '</code></pre>',
  '</main><footer>foot ', p_partkey, '</footer></body></html>')
"""


def api_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "part")).selectExpr(
        "p_partkey AS page_id", "concat('/docs/', lower(p_type), '/', p_partkey, '/') AS url", f"{API_PAGE} AS html"
    )


# One release-note page per order.
RELEASE_PAGE = r"""
concat(
  '<html><body><header><h2>API changes</h2><h3>January 01, 1999</h3></header><article><h1>Release notes</h1>',
  '<h2>API changes</h2>',
  '<h3>', date_format(o_orderdate, 'MMMM dd, yyyy'), '</h3>',
  '<h4>Feature ', o_orderkey, '</h4><p>First ', o_orderpriority, '</p><ul><li>a</li><li>b ', o_orderstatus, '</li></ul>',
  '<h4>Empty</h4>',
  '<h3>Earlier releases</h3><p>old ', o_custkey, '</p><h5>sub</h5>',
  '<h2>Unrelated</h2><h3>March 01, 2020</h3><p>skipped</p>',
  '<h2>Sandbox changes</h2>',
  '<h3>', date_format(o_orderdate, 'MMM d, yyyy'), '</h3><nav>menu</nav><pre>code ', o_orderkey, '</pre>',
  '<h3>Nothing here</h3>',
  '</article></body></html>')
"""


def release_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey AS page_id", "concat('/notes/', o_orderkey) AS url", f"{RELEASE_PAGE} AS html"
    )
