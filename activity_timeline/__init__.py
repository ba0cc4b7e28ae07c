"""Activity timelines from keyed, ordered signals, on Spark."""

from activity_timeline.params import Params, build_params
from activity_timeline.plans.analyze import analyze
from activity_timeline.plans.export import export
from activity_timeline.plans.ingest import ingest
from activity_timeline.plans.preview import preview

__all__ = ["Params", "analyze", "build_params", "export", "ingest", "preview"]
