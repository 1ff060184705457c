"""Graph partitioning and graph preparation as Spark DataFrame operators.

A graph is two frames: edges (src, dst, w), both directions of every edge
present, and vertices (v, vw). Labels are (v, part), cluster maps (v, c).
"""
