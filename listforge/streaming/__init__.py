"""Structured Streaming forms of the pipeline.

Every stream writes through foreachBatch into a versioned table whose version name carries the
batch id.  A batch reads the version before it and publishes its own, so a batch that is replayed
after a failure produces the same version again instead of applying itself twice.
"""
