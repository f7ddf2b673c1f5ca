"""Errors; messages are part of the interface."""


class Error(Exception):
    """Base of all errors of this package."""


class InvalidConfig(Error):
    def __init__(self, message: str):
        super().__init__(f"invalid config: {message}")


class ParseYaml(Error):
    def __init__(self, path, source):
        super().__init__(f"failed to parse YAML config {path}: {source}")


class ReadFile(Error):
    def __init__(self, path, source):
        super().__init__(f"failed to read {path}: {source}")


class WriteFile(Error):
    def __init__(self, path, source):
        super().__init__(f"failed to write {path}: {source}")


class UnsupportedColumnType(Error):
    def __init__(self, column: str, kind: str):
        super().__init__(f"unsupported Parquet column type for {column}: {kind}")


class InputPathNotFound(Error):
    def __init__(self, path):
        super().__init__(f"input path does not exist or is not accessible: {path}")


class NoParquetFiles(Error):
    def __init__(self, path):
        super().__init__(f"no Parquet files found under input path: {path}")


class UnsupportedFormat(Error):
    def __init__(self, what: str):
        super().__init__(f"unsupported dataset format: {what}")


class FileSizeBalancingNotImplemented(Error):
    def __init__(self):
        super().__init__("file_size_balancing strategy is not implemented as a standalone planner strategy; use adaptive_hash_salt")


class ResourceLimitExceeded(Error):
    def __init__(self, size_mb: int, limit_mb: int):
        super().__init__(f"resource limit exceeded: estimated dataset size {size_mb} MB exceeds configured memory limit {limit_mb} MB")


class CorrectnessMismatch(Error):
    """A method-aware result differs from the baseline."""
