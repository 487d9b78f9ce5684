"""hydrolens: leak analytics over household meter readings, expressed as Spark plans.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, so Catalyst can prune, push down and fuse them. Nothing is
collected to the driver except tiny scalar results that an operator needs to
configure itself (a bin width, a quantile threshold); those are documented at
the call site.
"""

__version__ = "0.1.0"
