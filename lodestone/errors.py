"""What the engine says instead of answering half a question."""


class Refusal(Exception):
    """A request that cannot be answered faithfully; `reason` names why."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


class SqlError(Refusal):
    """A statement outside the dialect, with the place in the text."""

    def __init__(self, reason: str, message: str, at: int = 0):
        super().__init__(reason, message)
        self.at = at
