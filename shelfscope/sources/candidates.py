"""The DOM pass: stored HTML in, candidate texts out, one Arrow batch at a time.

Python only looks elements up. Per field it emits the text found by each selector, NULL where a
selector matches nothing; which candidate counts, and every length, pattern, cast and fallback rule, is
decided afterwards by column expressions in ``operators.extract_*``. The pass is a map over scan
splits: no shuffle of HTML, and no state beyond one page.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfscope.sources import dom, layouts

# Workers get these two modules with the task, so a session needs no packaging step to use them.
cloudpickle.register_pickle_by_value(dom)
cloudpickle.register_pickle_by_value(layouts)


#: Pages whose candidates are Python objects at once. Thousands would be gone through again and again by the garbage collector.
AT_ONCE = 256
#: What ``item_faults`` calls a page that cannot be read at all.
PAGE_FAULT = "page"


def item_faults() -> Column:
    """Of a page with items: (pos, kind) of each that cannot be read, or one without a position for the whole page."""
    whole = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(PAGE_FAULT).alias("kind")))
    return F.when(F.col("found").isNull(), whole).otherwise(F.col("found.faults"))


def read_candidates(pages: DataFrame, layout: str) -> DataFrame:
    """All columns of ``pages`` but ``html``, and one ``found`` struct of the layout's candidates.

    ``found`` is NULL for a page that cannot be read, whatever is wrong with it.
    """
    reader, found = layouts.LAYOUTS[layout]
    carried = [f for f in pages.schema.fields if f.name != "html"]
    found_type = T.StructType.fromDDL(found)
    arrow_type = to_arrow_type(found_type)
    parse = dom.Page

    def read(html):
        try:
            return reader(parse(html or ""))
        except Exception:  # one malformed page must not end a job over all others; its NULL is counted as unreadable
            return None

    def run(batches):
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html"))
            found_rows = pa.concat_arrays(
                pa.array([read(page) for page in html.slice(at, AT_ONCE).to_pylist()], type=arrow_type) for at in range(0, max(1, len(html)), AT_ONCE)
            )
            keep = [batch.column(batch.schema.get_field_index(f.name)) for f in carried]
            yield pa.RecordBatch.from_arrays([*keep, found_rows], names=[*(f.name for f in carried), "found"])

    schema = T.StructType([*carried, T.StructField("found", found_type)])
    columns = [F.col(f.name) for f in carried]
    return pages.select(*columns, "html").mapInArrow(run, schema)
