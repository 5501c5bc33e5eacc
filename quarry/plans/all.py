"""Import every query family so that its queries are registered."""

from quarry.plans import tick_marts  # noqa: F401
from quarry.plans import operations  # noqa: F401
from quarry.plans import building  # noqa: F401
from quarry.plans import reshaping  # noqa: F401
from quarry.plans import checking  # noqa: F401
from quarry.plans import sourcing  # noqa: F401
