"""No operator of this engine is stream-only: every input is a finite set of edge lists or run records.

The DataFrame functions of `plexor.operators` hold for bounded tables; no watermark, window or state is defined.
"""
