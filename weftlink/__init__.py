"""Record linkage, calibration, profiling and training-text operators on Spark."""
