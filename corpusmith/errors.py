"""What can be wrong before a job starts."""


class SetupError(RuntimeError):
    """Something the user must do first: an input is missing or empty, an index was never built."""


class ConfigError(SetupError):
    """A configuration value is of the wrong kind or out of range."""


class ConfigNotFoundError(ConfigError):
    """No configuration file where one was named."""
