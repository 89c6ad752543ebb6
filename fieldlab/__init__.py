"""fieldlab: Spark jobs over fleets of devices that collect field samples."""
