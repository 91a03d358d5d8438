"""assayline: screen-evidence analytics and corpus preparation as Spark jobs.

Every public function takes and returns DataFrames; nothing is read or computed
on the driver beyond small, bounded tables (named in each docstring).
"""
