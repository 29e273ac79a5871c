from hitloom.plans.pipeline import main

main()
