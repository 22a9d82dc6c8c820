"""Survey coverage: parsing of a provider's replies, and the client that asks for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILES = "tiles array<struct<type:string,scale:int>>"


def tile_zoom(resources: Column, kind: str) -> Column:
    """Largest scale among the tile resources of a kind in a JSON document; null if there is none."""
    tiles = F.from_json(resources, TILES)["tiles"]
    return F.array_max(F.transform(F.filter(tiles, lambda t: t["type"] == kind), lambda t: t["scale"]))
