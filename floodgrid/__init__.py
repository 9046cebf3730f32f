"""floodgrid: flood-hazard and geodata analytics as PySpark DataFrame jobs."""
