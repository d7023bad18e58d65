"""relaylens: SMS-send conversion funnel and funds overview, as Spark jobs.

Two halves, both plain DataFrame plans:

* the funnel after each send (``relaylens.operators.funnel`` and
  ``relaylens.operators.attribution``);
* the funds picture (``relaylens.operators.funds``);

joined in one long metric table (``relaylens.operators.overview``) that
``relaylens.sources.sink`` records per day (``relaylens.plans.record_job``
is the daily command).  ``relaylens.operators.asof`` holds the skew-safe
as-of lookups used when single users are hot.  ``relaylens.plans.queries``
registers every job by name; ``relaylens.streaming`` holds the continuous
versions of the event-side jobs.
"""

from relaylens.params import DEFAULT_HOURS, DEFAULT_STEPS, FunnelSpec

__all__ = ["DEFAULT_HOURS", "DEFAULT_STEPS", "FunnelSpec"]
