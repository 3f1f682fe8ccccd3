"""Small response bodies in each source's envelope. All values are invented."""

import json

from callharmony.schema import PAGE_SCHEMA


def features(*rows):
    return json.dumps({"features": [{"attributes": row} for row in rows]})


def datastore(*rows, truncated=None):
    result = {"records": list(rows)}
    if truncated is not None:
        result["records_truncated"] = truncated
    return json.dumps({"result": result})


def row_array(*rows):
    return json.dumps(list(rows))


ERROR = json.dumps({"error": {"code": 400, "message": "no"}})


def pages(spark, *bodies, dataset="d", run_id="r1"):
    rows = [(dataset, run_id, seq, body) for seq, body in enumerate(bodies)]
    return spark.createDataFrame(rows, PAGE_SCHEMA)
