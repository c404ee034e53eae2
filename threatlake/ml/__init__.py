"""Models on MLlib, an isolation forest, oversampling, evaluation and the scoring job."""
