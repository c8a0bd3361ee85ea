"""tessera: detection, segmentation and tracking analytics as Spark jobs, with corpus operators in ``tessera.llm``."""
