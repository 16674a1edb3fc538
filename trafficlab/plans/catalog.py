"""All registered queries (importing the family modules fills the registry)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_flows, q_sampling  # noqa: F401
from .registry import REGISTRY, Entry

_FAMILIES = ["q_flows", "q_labels", "q_prep", "q_ml", "q_evaluate", "q_misc", "q_spec", "q_streaming"]
for _m in _FAMILIES:
    try:
        __import__(f"{__package__}.{_m}")
    except ModuleNotFoundError as e:  # family not written yet
        if _m not in str(e):
            raise


def entries() -> dict[str, Entry]:
    return dict(REGISTRY)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.flows import agm_vector
    from ..operators.sampling import sample_packets
    from ..sources.tables import pkt_user
    sampled = sample_packets(pkt_user(spark, sf_dir), "every_nth", 2)
    return agm_vector(sampled, window_seconds=5 * 86400)
