"""Values that several test files share."""

from datetime import datetime

NOW = datetime(2024, 6, 30, 12, 0, 0)
