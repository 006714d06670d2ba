"""Line counts over streams: lexing keeps no state, so ``file_stats`` serves streams as it is."""
