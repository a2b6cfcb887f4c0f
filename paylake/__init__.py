"""paylake: payments and fraud analytics as plain Spark DataFrame jobs.

Every operator is a function ``DataFrame(s) + parameters -> DataFrame``.
Nothing is collected to the driver; reference dates are explicit ``as_of``
arguments, never the wall clock.
"""

from paylake.session import build_session, checkpoint_root, read_table

__all__ = ["build_session", "checkpoint_root", "read_table"]
