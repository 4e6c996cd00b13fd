"""SNK18. Errors with codes, and the envelope they are printed in."""

from __future__ import annotations

import json


class GraphError(Exception):
    code = "internal_error"

    def envelope(self) -> str:
        return json.dumps({"error": {"code": self.code, "message": str(self)}})


class NotFound(GraphError):
    code = "not_found"


class InvalidInput(GraphError):
    code = "invalid_input"


class Conflict(GraphError):
    code = "conflict"


class ConfigError(GraphError):
    code = "config_error"


class Busy(GraphError):
    code = "in_progress"


class StaleIndex(GraphError):
    code = "stale_index"
