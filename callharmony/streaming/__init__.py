from callharmony.streaming.incremental import run_stream

__all__ = ["run_stream"]
