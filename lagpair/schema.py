"""Explicit schemas of the tables that sources give and sinks take."""

METADATA = "group_name string, dataset_idx long"
PAIRS = "ID string, Year_Before string, Month_Before string, Day_Before string, Year_After string, Month_After string, Day_After string"
EMBEDDINGS = "dataset_idx long, embedding array<float>"
SIGNALS = "group_name string, pos int, channel string, samples array<float>"
CHANNEL_IMPORTANCE = "Channel string, Mean_Importance_T0 double, Mean_Importance_T1 double"
METRICS = "epoch int, train_loss double, train_acc double, train_auroc double, val_loss double, val_acc double, val_auroc double"
