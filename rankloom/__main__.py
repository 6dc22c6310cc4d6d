from rankloom.plans.cli import run

run()
