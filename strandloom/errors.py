"""What can be wrong with names, expressions and inputs."""


class StrandError(Exception):
    """Any error of this library."""


class ExpressionError(StrandError, ValueError):
    """A selector, transform, template, name or pattern list that cannot be read; raised while the plan is built."""


class ReadNameError(StrandError, KeyError):
    """A string type, label or attribute that is not in a read, is there twice, or has another type."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class FastqError(StrandError, RuntimeError):
    """A record that is no FASTQ record, or a mate that is missing."""
