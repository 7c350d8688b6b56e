from tidewatch.streaming.featurize import featurize_stream, start_feature_stream

__all__ = ["featurize_stream", "start_feature_stream"]
