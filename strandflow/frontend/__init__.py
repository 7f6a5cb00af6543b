"""The one order-dependent stage: program text to flat fact rows, a program at a time on the executors."""
