"""All registered queries of the library."""

from weftline.plans import events, jobs, media, reports, scans, streams, style, texts, upkeep  # noqa: F401
from weftline.plans.registry import ORACLES, QUERIES  # noqa: F401
