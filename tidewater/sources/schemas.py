"""Table schemas of the observation, corpus, evaluation and log tables."""

from __future__ import annotations

MANIFEST = (
    "sighting_id bigint, individual_id bigint, asset_ref string, source_url string, status string"
)
RASTER_TILES = (
    "year int, rid int, ulx double, uly double, scale double, width int, height int, "
    "pixels array<int>, srid int"
)
DOWNLOAD_TASKS = "individual_id string, sighting_id string, url string"
MESSAGES = (
    "conv_id bigint, turn bigint, msg_id string, role string, content string, "
    "tool_calls array<struct<id:string,name:string,args:string>>, tool_call_id string"
)
USAGE_LOG = "role string, input_tokens bigint, output_tokens bigint"
