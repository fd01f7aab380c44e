"""Record pipelines over streams."""

from .pipelines import open_stream, run_to_end, shared_folder, stateless

__all__ = ["open_stream", "run_to_end", "shared_folder", "stateless"]
